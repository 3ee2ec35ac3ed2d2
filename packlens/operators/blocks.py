"""Reader output: words to lines, boxes, reading order, duplicate boxes, clear space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.geometry import overlap, rect_of, sizes_of
from ..functions.text import ANY_CASE, bound, strip
from ..sources.shared import written

LEAST_CONFIDENCE = 0.20
SAME_BOX = 0.40
SAME_SYMBOL = 0.30
LINE_KEYS = ["image_id", "page_num", "block_num", "par_num", "line_num"]


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words joined to lines: text in word order, mean confidence as a share, the box around them.

    Blank words and those without confidence are left out; lines under the least
    confidence go.
    """
    held = words.where((strip(F.col("text")) != "") & (F.col("conf") > 0))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"])
    lines = held.groupBy(*LINE_KEYS).agg(
        F.array_join(texts, " ").alias("text"), (F.avg("conf") / 100).alias("confidence"), F.min("left").alias("x1"), F.min("top").alias("y1"), F.max(right).alias("x2"), F.max(bottom).alias("y2"))
    return lines.where((F.col("confidence") >= LEAST_CONFIDENCE) & (strip(F.col("text")) != ""))


def lines_of_word_lists(lists: DataFrame) -> DataFrame:
    """``lines_of_words`` of words that come as arrays of structs ``words``, as readers return them.

    No row is made for a word. A line that is one array, as most are, is finished where
    it is; only lines of which several arrays are found, by their keys, are shuffled.
    """
    kept = F.filter("words", lambda w: (strip(w["text"]) != "") & (w["conf"] > 0))
    held = lists.select(*LINE_KEYS, F.explode_outer(F.array(kept)).alias("words")).where(F.size("words") > 0)
    repeated = written(held.groupBy(*LINE_KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*LINE_KEYS), "repeated").alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in LINE_KEYS])
    single = held.alias("l").join(repeated, same, "left_anti")
    joined = held.alias("l").join(repeated, same, "left_semi").groupBy(*LINE_KEYS).agg(F.flatten(F.collect_list("words")).alias("words"))

    def line(words: Column) -> Column:
        texts = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(w["word_no"], w["text"]))), lambda w: w["text"])
        return F.struct(
            F.array_join(texts, " ").alias("text"), (F.aggregate(words, F.lit(0.0), lambda a, w: a + w["conf"]) / F.size(words) / 100).alias("confidence"),
            F.array_min(F.transform(words, lambda w: w["left"])).alias("x1"), F.array_min(F.transform(words, lambda w: w["top"])).alias("y1"),
            F.array_max(F.transform(words, lambda w: w["left"] + w["width"])).alias("x2"), F.array_max(F.transform(words, lambda w: w["top"] + w["height"])).alias("y2"))

    lines = single.unionByName(joined).select(*LINE_KEYS, F.inline_outer(F.array(bound(line, F.col("words")))))  # a generator, so that the filter isn't worked out again below
    return lines.where((F.col("confidence") >= LEAST_CONFIDENCE) & (strip(F.col("text")) != ""))


def confident_words(words: DataFrame, least: float = 20.0) -> DataFrame:
    return words.where(F.col("conf") > least)


def finished_blocks(blocks: DataFrame) -> DataFrame:
    """Trimmed text, sizes and centre of each block, and its place in reading order (top to bottom, left to right)."""
    trimmed = blocks.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & (F.col("confidence") >= LEAST_CONFIDENCE))
    sized = trimmed.withColumn("_s", sizes_of(F.col("bbox"))).select("*", F.col("_s.height").alias("height_px"), F.col("_s.width").alias("width_px"), F.col("_s.cx").alias("cx"), F.col("_s.cy").alias("cy")).drop("_s")
    order = Window.partitionBy("image_id").orderBy("cy", "cx", "block_no")
    return sized.withColumn("reading_no", F.row_number().over(order))


def full_text(blocks: DataFrame, separator: str = "\n") -> DataFrame:
    """One row an image: all texts in reading order, mean confidence, number of blocks."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("reading_no", "text"))), lambda b: b["text"])
    return blocks.groupBy("image_id").agg(F.array_join(texts, separator).alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"), F.count("*").cast("int").alias("total_blocks"))


def kept_greedily(boxes: Column, limit: float, same: Column | None = None, floor: bool = False) -> Column:
    """Of boxes in order, those that overlap no kept one by more than ``limit``; ``same`` names a field that must agree."""
    def step(kept: Column, box: Column) -> Column:
        def clash(other: Column) -> Column:
            over = overlap(box["rect"], other["rect"], floor) > limit
            return over & (box["kind"] == other["kind"]) if same is not None else over

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(boxes, F.filter(boxes, lambda _: F.lit(False)), step)


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """Greedy suppression by image: the most confident box stays, those that overlap it go; ``image_id, box_no, confidence``.

    An image holds few boxes, so each is one array; images are never joined.
    """
    rows = boxes.where(F.col("confidence") >= LEAST_CONFIDENCE).select("image_id", F.struct((-F.col("confidence")).alias("rank"), "box_no", F.struct("x1", "y1", "x2", "y2").alias("rect")).alias("box"))
    kept = rows.groupBy("image_id").agg(kept_greedily(F.array_sort(F.collect_list("box")), SAME_BOX).alias("kept"))
    return kept.select("image_id", F.explode("kept").alias("k")).select("image_id", "k.box_no", (-F.col("k.rank")).alias("confidence"))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Like ``distinct_boxes`` within a class: detections of the trained model first, then by confidence."""
    first = (F.col("source") != "yolo").cast("int").alias("late")
    rows = symbols.select("image_id", F.struct(first, (-F.col("confidence")).alias("rank"), "symbol_no", F.col("class_name").alias("kind"), F.struct("x1", "y1", "x2", "y2").alias("rect")).alias("box"))
    kept = rows.groupBy("image_id").agg(kept_greedily(F.array_sort(F.collect_list("box")), SAME_SYMBOL, F.lit("kind"), True).alias("kept"))
    return kept.select("image_id", F.explode("kept").alias("k")).select("image_id", "k.symbol_no", F.col("k.kind").alias("class_name"), (-F.col("k.rank")).alias("confidence"))


def symbol_flags(symbols: DataFrame) -> DataFrame:
    """Which marks an image shows with a confidence over a half."""
    def shown(*classes: str) -> Column:
        return F.coalesce(F.bool_or(F.col("class_name").isin(*classes) & (F.col("confidence") > 0.5)), F.lit(False))

    return symbols.groupBy("image_id").agg(
        shown("fssai_logo").alias("has_fssai_logo"), shown("veg_symbol", "nonveg_symbol").alias("has_veg_nonveg_symbol"), shown("isi_mark").alias("has_isi_mark"),
        shown("recycling_symbol").alias("has_recycling_symbol"), shown("barcode", "qr_code").alias("has_barcode"))


def clear_space(boxes: DataFrame, pixels_per_mm: float) -> DataFrame:
    """Free space in mm around each box to the nearest box that shares its rows or columns; infinite without one.

    Boxes within two pixels of the box itself count as itself. Pairs are joined
    by image only.
    """
    a, b = boxes.alias("a"), boxes.alias("b")
    same = (F.abs(F.col("a.x1") - F.col("b.x1")) < 2) & (F.abs(F.col("a.y1") - F.col("b.y1")) < 2) & (F.abs(F.col("a.x2") - F.col("b.x2")) < 2) & (F.abs(F.col("a.y2") - F.col("b.y2")) < 2)
    columns = (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2")) & ~same
    rows = (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2")) & ~same
    gaps = {
        "above": F.when(columns & (F.col("b.y2") <= F.col("a.y1")), F.col("a.y1") - F.col("b.y2")),
        "below": F.when(columns & (F.col("b.y1") >= F.col("a.y2")), F.col("b.y1") - F.col("a.y2")),
        "left": F.when(rows & (F.col("b.x2") <= F.col("a.x1")), F.col("a.x1") - F.col("b.x2")),
        "right": F.when(rows & (F.col("b.x1") >= F.col("a.x2")), F.col("b.x1") - F.col("a.x2")),
    }
    pairs = a.join(b, F.col("a.image_id") == F.col("b.image_id")).groupBy(F.col("a.image_id").alias("image_id"), F.col("a.box_no").alias("box_no"))
    return pairs.agg(*[F.coalesce(F.min(g) / pixels_per_mm, F.lit(float("inf"))).alias(f"{side}_mm") for side, g in gaps.items()])


def commodity_names(blocks: DataFrame) -> DataFrame:
    """``image_id, commodity_name``: the tallest block of the upper half unless it is a stop word, else the next that is no stop word and over two characters."""
    image = Window.partitionBy("image_id")
    upper = blocks.withColumn("_upper", F.col("cy") < F.max("cy").over(image) * 0.5)
    upper = upper.withColumn("_any", F.max("_upper").over(image)).where(F.col("_upper") | ~F.col("_any"))
    name = strip(F.col("text"))
    ranked = upper.withColumn("_rank", F.row_number().over(image.orderBy(F.col("height_px").desc(), "reading_no")))
    fits = ~name.rlike(ANY_CASE + fixed.NOT_A_NAME) & ((F.col("_rank") == 1) | (F.length(name) > 2))
    return ranked.groupBy("image_id").agg(F.min_by(F.when(fits, name), F.when(fits, F.col("_rank"))).alias("commodity_name"))


def ruler_pixels_per_mm(ticks: DataFrame) -> DataFrame:
    """``image_id, pixels_per_mm, ticks`` from tick positions: mean of the spacings within 30 % of their median; five ticks and four such spacings at least."""
    order = Window.partitionBy("image_id").orderBy("x")
    spacing = ticks.withColumn("gap", F.col("x") - F.lag("x").over(order))
    middle = spacing.groupBy("image_id").agg(F.median("gap").alias("median"), F.count("*").alias("ticks"))
    near = F.col("median") > 0
    kept = spacing.join(middle, "image_id").where(near & (F.abs(F.col("gap") - F.col("median")) / F.col("median") < 0.30))
    return kept.groupBy("image_id", "ticks").agg(F.avg("gap").alias("pixels_per_mm"), F.count("*").alias("_n")).where((F.col("ticks") >= 5) & (F.col("_n") >= 4)).drop("_n")


def font_metrics(blocks: DataFrame, least: Column) -> DataFrame:
    """Letter sizes in mm (two decimals) of calibrated blocks, and whether the unrounded height is enough."""
    height = F.col("height_px") / F.col("pixels_per_mm")
    return blocks.withColumn("height_mm", F.round(height, 2)).withColumn("width_mm", F.round(F.col("width_px") / F.col("pixels_per_mm"), 2)).withColumn("least_mm", least).withColumn("meets", height >= F.col("least_mm"))


def with_rect(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("rect", rect_of(F.col("bbox")))
