"""Text regions of an image: density clusters (DBSCAN) of block centres, by grid cells and components.

Cells are so small that all points of one are neighbours. So clusters are connected
components of cells, never of points: two cells are linked if some point of one is
near some point of the other, which their boxes mostly settle, and smaller cells
where they don't. No task holds such an image, and crowded cells are never joined pair by pair.

Images of up to FEW points, as labels are, need no cells: their points are shuffled once,
as one array an image, and compared where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.shared import written

#: Share of eps that is a cell's side: its diagonal stays just under eps.
SIDE = 0.5**0.5 * (1 - 1e-9)
#: Offsets of cells that may hold neighbours of a cell's points.
REACH = 2
#: Two cells are compared point by point if that takes so many pairs at most.
PAIRS = 4096
#: Images of more points are cut into cells.
FEW = 1000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of ``links(a, b)``; nodes are of any ordered type.

    Each round points every node to its least neighbour, follows the pointers twice
    and keeps the links between different nodes pointed to.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        step = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        for _ in range(2):
            step = written(step, "pointers")
            step = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        step = written(step, "pointers")
        moved = labels.alias("l").join(step.alias("s"), F.col("l.component") == F.col("s.node"), "left")
        labels = written(moved.select("l.node", F.coalesce("s.to", "l.component").alias("component")), "labels")
        ends = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        links = written(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels


def cell(level: int = 0) -> Column:
    """The cell of a point; each level halves its sides."""
    side = F.col("eps") * SIDE / 2**level
    return F.struct(F.floor(F.col("x") / side).alias("i"), F.floor(F.col("y") / side).alias("j"))


def neighbours(of: Column) -> Column:
    """The cells around a cell, itself left out, that may hold points within eps; corners are too far."""
    offsets = [(i, j) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1) if 0 < i * i + j * j < 2 * REACH * REACH]
    return F.array(*[F.struct((of["i"] + i).alias("i"), (of["j"] + j).alias("j")) for i, j in offsets])


def square(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def is_near(a: str = "a", b: str = "b") -> Column:
    return square(F.col(f"{a}.x"), F.col(f"{b}.x")) + square(F.col(f"{a}.y"), F.col(f"{b}.y")) <= F.col(f"{a}.eps") * F.col(f"{a}.eps")


def with_core(points: DataFrame, least: int) -> DataFrame:
    """``points`` with ``core``: whether ``least`` points, the point itself too, are within eps.

    All points of a cell with that many are. The others, fewer than ``least`` in a cell, are
    compared with the cells around, so the work is at most ``least`` times the points.
    """
    sizes = written(points.groupBy("image_id", "cell").agg(F.sum("n").alias("held")), "cells")
    full = points.join(sizes.where(F.col("held") >= least), ["image_id", "cell"], "left_semi").withColumn("core", F.lit(True))
    few = points.join(sizes.where(F.col("held") < least), ["image_id", "cell"])
    around = few.select("*", F.explode(neighbours(F.col("cell"))).alias("at"))
    close = around.alias("a").join(points.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.at") == F.col("b.cell")) & is_near())
    more = close.groupBy("a.image_id", "a.x", "a.y").agg(F.sum("b.n").alias("more"))
    held = few.join(more, ["image_id", "x", "y"], "left")
    return full.unionByName(held.withColumn("core", F.col("held") + F.coalesce("more", F.lit(0)) >= least).select(*points.columns, "core"))


def boxed(core: DataFrame, level: int) -> DataFrame:
    """The cells of a level: box and number of points of each, and its cell one level up."""
    up = cell(max(level - 1, 0))
    return core.groupBy("image_id", cell(level).alias("cell")).agg(
        F.first(up).alias("up"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n"), F.first("eps").alias("eps"))


def gaps() -> tuple[Column, Column]:
    """Squares of the least and of the greatest distance that points of boxes ``a`` and ``b`` can have."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in ("x", "y"):
        low, high = F.greatest(f"a.{c}1", f"b.{c}1"), F.least(f"a.{c}2", f"b.{c}2")
        least = least + square(F.greatest(low - high, F.lit(0.0)), F.lit(0.0))
        most = most + square(F.greatest(f"a.{c}2", f"b.{c}2"), F.least(f"a.{c}1", f"b.{c}1"))
    return least, most


def linked_cells(core: DataFrame) -> DataFrame:
    """``image_id, a, b``: pairs of cells of core points of which two are within eps.

    Boxes that are all within eps are linked, boxes beyond it are not. Of the others,
    small ones are compared point by point; large ones are split into quarters, whose
    boxes are tighter, level by level. A pair that is linked is not looked at again.
    """
    cells = written(boxed(core, 0), "boxes")
    around = cells.select("*", F.explode(F.filter(neighbours(F.col("cell")), lambda c: c > F.col("cell"))).alias("at"))
    pairs = around.alias("a").join(cells.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.at") == F.col("b.cell")))
    tops = (F.col("a.cell").alias("top_a"), F.col("b.cell").alias("top_b"))
    found, level = None, 0
    while True:
        least, most = gaps()
        limit = F.col("a.eps") * F.col("a.eps")
        pairs = written(pairs.where(least <= limit).select("a.image_id", *tops, F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), (most <= limit).alias("sure"), (F.col("a.n") * F.col("b.n")).alias("work")), "pairs")
        here = core.select("image_id", cell(level).alias("cell"), "x", "y", "eps")
        few = pairs.where(~F.col("sure") & (F.col("work") <= PAIRS))
        left = few.join(here.withColumnRenamed("cell", "a"), ["image_id", "a"])
        both = left.alias("a").join(here.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.b") == F.col("b.cell")) & is_near())
        new = pairs.where("sure").select("image_id", "top_a", "top_b").unionByName(both.select("a.image_id", "a.top_a", "a.top_b")).distinct()
        found = written(new if found is None else found.unionByName(new), "linked")
        open_ = pairs.where(~F.col("sure") & (F.col("work") > PAIRS)).join(found, ["image_id", "top_a", "top_b"], "left_anti")
        if open_.isEmpty():
            return found.select("image_id", F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct()
        level += 1
        cells = written(boxed(core, level), "boxes")
        quarter = lambda side: cells.select(F.struct("image_id", F.col("up")).alias("of"), F.struct(*[c for c in cells.columns if c != "up"]).alias(side))
        split = open_.join(quarter("qa"), F.col("of") == F.struct(open_["image_id"], open_["a"])).drop("of", "a")
        split = split.join(quarter("qb"), F.col("of") == F.struct(F.col("image_id"), F.col("b"))).drop("of", "b", "image_id")
        pairs = split.withColumnsRenamed({"qa": "a", "qb": "b"})
        tops = (F.col("top_a"), F.col("top_b"))


def regions_of(points: Column, eps: Column, least: int) -> Column:
    """The region of each point of an array of structs with x and y: ``clustered`` of one image, whose points are in order."""
    numbered = F.transform(points, lambda p, i: F.struct(i.alias("i"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))

    def close(p: Column, e: Column) -> Column:
        def to(a: Column) -> Column:
            return F.transform(F.filter(p, lambda b: square(a["x"], b["x"]) + square(a["y"], b["y"]) <= e * e), lambda b: b["i"])

        return F.transform(p, to)

    def joined(labels: Column, around: Column) -> Column:
        """``labels`` after the points ``around`` one are put together under their least label."""
        def same(ends: Column, low: Column) -> Column:
            return F.when(F.size(ends) < 2, labels).otherwise(F.transform(labels, lambda x: F.when(F.array_contains(ends, x), low).otherwise(x)))

        return F.when(F.size(around) < 2, labels).otherwise(bound(lambda ends: bound(same, ends, F.array_min(ends)), F.array_distinct(F.transform(around, lambda j: F.get(labels, j)))))

    def labelled(near: Column) -> Column:
        def with_cores(core: Column) -> Column:
            cores = F.transform(near, lambda js: F.filter(js, lambda j: F.get(core, j)))  # core points near each point
            linked = F.transform(cores, lambda js, i: F.when(F.get(core, i), js).otherwise(F.slice(js, 1, 0)))
            labels = F.aggregate(linked, F.transform(near, lambda _, i: i), joined)
            return bound(lambda js, found: F.transform(js, lambda around: F.array_min(F.transform(around, lambda j: F.get(found, j)))), cores, labels)

        return bound(with_cores, F.transform(near, lambda js: F.size(js) >= least))

    def ranked(firsts: Column) -> Column:
        return bound(lambda roots: F.transform(firsts, lambda x: F.coalesce(F.array_position(roots, x) - 1, F.lit(-1)).cast("int")), F.array_sort(F.array_distinct(F.filter(firsts, lambda x: x.isNotNull()))))

    return bound(ranked, bound(labelled, bound(close, numbered, eps)))


def crowded_images(points: DataFrame) -> DataFrame | None:
    """``image_id`` of the images of more than FEW points; None if there are none."""
    found = written(points.where("image_id IS NOT NULL").groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("image_id"), "crowded")
    return None if found.isEmpty() else found


def clustered(points: DataFrame, eps: float | Column, least: int = 2) -> DataFrame:
    """DBSCAN by image of ``points(image_id, point_no, x, y)``: adds ``region``, -1 for noise.

    A point with ``least`` points within ``eps`` (a number or a column, one value an image; itself
    counts) is a core point; core points within eps are in one region, other points within eps
    of a core point in the first such region, the rest is noise. Regions are numbered
    from 0 by their first core point. Points without a place are noise. An empty table
    gives no rows.
    """
    held = points.select("image_id", "point_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (eps if isinstance(eps, Column) else F.lit(float(eps))).alias("eps"))
    crowded = crowded_images(held)
    few = held if crowded is None else held.join(crowded, "image_id", "left_anti")
    images = few.where("image_id IS NOT NULL").groupBy("image_id").agg(F.first("eps").alias("eps"), F.array_sort(F.collect_list(F.struct("point_no", "x", "y"))).alias("points"))
    each = images.select("image_id", F.inline(F.arrays_zip("points", regions_of(F.col("points"), F.col("eps"), least).alias("region"))))
    found = each.select("image_id", "points.point_no", "points.x", "points.y", "region")
    found = found.unionByName(held.where("image_id IS NULL").select("image_id", "point_no", "x", "y", F.lit(-1).alias("region")))
    return found if crowded is None else found.unionByName(clustered_by_cells(held.join(crowded, "image_id", "left_semi"), least))


def clustered_by_cells(held: DataFrame, least: int) -> DataFrame:
    """``clustered`` of ``held(image_id, point_no, x, y, eps)`` for images of any number of points."""
    placed = held.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND image_id IS NOT NULL")
    spots = placed.groupBy("image_id", "x", "y", "eps").agg(F.count("*").alias("n"), F.min("point_no").alias("first_no"))
    spots = written(with_core(written(spots.withColumn("cell", cell()), "spots"), least), "core")
    core = spots.where("core")
    name = lambda c: F.struct("image_id", F.col(c).alias("cell")).alias(c)
    found = components(linked_cells(core).select(name("a"), name("b")))
    own = core.select(F.struct("image_id", "cell").alias("node"), "image_id", "x", "y", "first_no").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = own.groupBy("image_id", "component").agg(F.min("first_no").alias("first_no"))
    order = Window.partitionBy("image_id").orderBy("first_no")  # a row a region
    numbered = written(firsts.withColumn("region", F.row_number().over(order) - 1).select("component", "region"), "regions")
    labelled = written(own.join(numbered, "component").select("image_id", "x", "y", "region"), "labelled")
    rest = spots.where("NOT core").select("image_id", "cell", "x", "y", "eps", F.explode(F.concat(F.array("cell"), neighbours(F.col("cell")))).alias("at"))
    cores = core.select("image_id", "cell", "x", "y").join(labelled, ["image_id", "x", "y"])
    touched = rest.alias("a").join(cores.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.at") == F.col("b.cell")) & is_near())
    border = touched.groupBy("a.image_id", "a.x", "a.y").agg(F.min("b.region").alias("region"))
    all_ = labelled.unionByName(border)
    return held.join(all_, ["image_id", "x", "y"], "left").select("image_id", "point_no", "x", "y", F.coalesce("region", F.lit(-1)).cast("int").alias("region"))


def region_boxes(found: DataFrame) -> DataFrame:
    """Box and size of each region; noise is one region."""
    return found.groupBy("image_id", "region").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("points"))


def label_regions(blocks: DataFrame, images: DataFrame, eps: float = 50.0, least: int = 2) -> DataFrame:
    """The regions of finished reader blocks: image_id, region, x1, y1, x2, y2, text, blocks.

    ``images(image_id, width, height)`` sets the scale: ``eps`` is for a diagonal of 1,000
    pixels. A region's box is around its blocks' corners, its text has theirs from
    top to bottom (ties: as read). Blocks that are near none are one region, -1. An
    image of unknown size is one region, 0, with all text as read and no box.
    """
    sized = images.select("image_id", (F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")) * eps / 1000).alias("_eps")).where("_eps > 0")
    slim = blocks.select("image_id", "block_no", "text", "cx", "cy", "rect")
    crowded = crowded_images(slim)
    few = slim if crowded is None else slim.join(crowded, "image_id", "left_anti")
    block = F.struct("block_no", F.col("cx").alias("x"), F.col("cy").alias("y"), "text", "rect")
    whole = few.groupBy("image_id").agg(F.array_sort(F.collect_list(block)).alias("held")).join(sized.hint("shuffle_hash"), "image_id", "left")
    numbers = F.when(F.col("_eps").isNotNull(), regions_of(F.col("held"), F.col("_eps"), least)).otherwise(F.transform("held", lambda _: F.lit(0)))
    each = whole.select("image_id", "_eps", F.inline(F.arrays_zip("held", numbers.alias("region"))))
    found = regions_of_blocks(each.select("image_id", "_eps", "region", "held.block_no", "held.text", F.col("held.y").alias("cy"), "held.rect"))
    if crowded is None:
        return found
    held = written(slim.join(crowded, "image_id", "left_semi").join(sized, "image_id", "left"), "blocks")
    points = held.where("_eps IS NOT NULL").select("image_id", F.col("block_no").alias("point_no"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), F.col("_eps").alias("eps"))
    numbered = clustered_by_cells(points, least).select("image_id", F.col("point_no").alias("block_no"), "region")
    known = held.where("_eps IS NOT NULL").join(numbered, ["image_id", "block_no"])
    return found.unionByName(regions_of_blocks(known)).unionByName(single_region(held.where("_eps IS NULL")))


def regions_of_blocks(known: DataFrame) -> DataFrame:
    """A row for each region of ``known(image_id, _eps, region, block_no, text, cy, rect)``; an image without ``_eps`` has no box and its text as read."""
    sized = F.col("_eps").isNotNull()
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.when(sized, F.col("cy")).alias("cy"), "block_no", "text"))), lambda b: b["text"])
    boxes = [f(F.when(sized, F.col(f"rect.{c}"))).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]
    return known.groupBy("image_id", "region").agg(*boxes, F.array_join(texts, " ").alias("text"), F.count("*").alias("blocks"))


def single_region(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One region an image, without clustering: the whole image as its box (unknown without ``images``), and all text as read."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"])
    rows = blocks.groupBy("image_id").agg(F.array_join(texts, " ").alias("text"), F.count("*").alias("blocks"))
    if images is not None:
        rows = rows.join(images.select("image_id", "width", "height"), "image_id", "left")
    far = [F.col(c).cast("double") if images is not None else F.lit(None).cast("double") for c in ("width", "height")]
    zero = F.when(far[0].isNotNull() & far[1].isNotNull(), F.lit(0.0))
    return rows.select("image_id", F.lit(0).alias("region"), zero.alias("x1"), zero.alias("y1"), far[0].alias("x2"), far[1].alias("y2"), "text", "blocks")
