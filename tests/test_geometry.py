"""Ladders, boxes and regions."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from packlens.functions import geometry
from packlens.operators import blocks, regions
from packlens.sources import files, scans_of_files, tables

SF = "/root/testdata/sf0.001"


def test_ladders(spark):
    df = spark.createDataFrame([(float(q),) for q in (50, 50.01, 200, 250, 400, 1000, 2000, 12000, 20000)], "q double")
    assert [r.v for r in df.select(F.round(geometry.permitted_error(F.col("q"), F.lit(" Weight"))["limit"], 6).alias("v")).collect()] == [4.5, 4.5, 4.5, 9.0, 12.0, 15.0, 30.0, 150.0, 200.0]
    df = spark.createDataFrame([(float(a),) for a in (50, 50.1, 500, 2500, 2501)], "a double")
    assert [r.v for r in df.select(geometry.least_height(F.col("a")).alias("v")).collect()] == [1.0, 1.5, 2.5, 4.0, 6.0]
    near = spark.createDataFrame([("coffee", 75.0), ("bread", 600.0), ("what", 1.0)], "k string, q double")
    assert [r.v for r in near.select(geometry.nearest_standard(F.col("k"), F.col("q")).alias("v")).collect()] == [50.0, 500.0, None]


def test_kept_boxes_overlap_little_and_dropped_ones_much(spark):
    boxes = tables.boxes(spark, SF)
    kept = {(r.image_id, r.box_no) for r in blocks.distinct_boxes(boxes).collect()}
    by = {}
    for r in boxes.collect():
        by.setdefault(r.image_id, []).append(r)

    def iou(a, b):
        w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
        both = max(w, 0) * max(h, 0)
        return both / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - both + 1e-6)

    for image, held in by.items():
        inside = [b for b in held if (image, b.box_no) in kept]
        assert all(iou(a, b) <= 0.4 for a, b in itertools.combinations(inside, 2))
        for b in held:
            if (image, b.box_no) not in kept:
                assert any(iou(a, b) > 0.4 and a.confidence >= b.confidence for a in inside)


def test_regions_of_chains_and_noise(spark):
    rows = [(1, i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 10, 20, 21])]
    found = regions.clustered(spark.createDataFrame(rows, "image_id int, point_no int, x double, y double"), 1.5)
    assert [r.region for r in found.orderBy("point_no").collect()] == [0, 0, 0, -1, 1, 1]


def test_border_points_need_a_core(spark):
    rows = [(1, i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 3.4])]
    found = regions.clustered(spark.createDataFrame(rows, "image_id int, point_no int, x double, y double"), 1.5, least=3)
    assert [r.region for r in found.orderBy("point_no").collect()] == [0, 0, 0, 0]


def plain_regions(points, eps, least):
    """DBSCAN of one image as it is defined: points in order, regions grown from core points."""
    near = [[j for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in points]
    label, current = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] >= 0 or len(near[i]) < least:
            continue
        todo, label[i] = [i], current
        while todo:
            j = todo.pop()
            if len(near[j]) >= least:
                for k in near[j]:
                    if label[k] < 0:
                        label[k] = current
                        todo.append(k)
        current += 1
    return label


@pytest.mark.parametrize(("least", "pairs"), [(2, 4096), (2, 4), (4, 4), (7, 1)])
def test_regions_of_any_points(spark, monkeypatch, least, pairs):
    """Sparse, crowded and repeated points; cells are split where few pairs may be compared."""
    monkeypatch.setattr(regions, "PAIRS", pairs)
    rng = random.Random(least)
    images = {1: [(rng.random(), rng.random()) for _ in range(120)], 2: [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(90)] + [(0.3, 0.3)] * 9, 3: [(i * 0.05, (i % 2) * 0.01) for i in range(-40, 40)], 4: [(1.0, 2.0)]}
    rows = [(i, n, *p) for i, ps in images.items() for n, p in enumerate(ps)]
    found = regions.clustered(spark.createDataFrame([*rows, (5, 0, None, 1.0)], "image_id int, point_no int, x double, y double").repartition(3), 0.05, least).collect()
    got = {(r.image_id, r.point_no): r.region for r in found}
    assert got.pop((5, 0)) == -1
    assert got == {(i, n): r for i, ps in images.items() for n, r in enumerate(plain_regions(ps, 0.05, least))}
    assert regions.clustered(spark.createDataFrame([], "image_id int, point_no int, x double, y double"), 1.0).count() == 0


@pytest.mark.parametrize(("few", "least", "pairs"), [(0, 2, 4096), (0, 2, 4), (0, 4, 4), (0, 7, 1), (100, 3, 4096)])
def test_regions_of_few_and_of_many_points(spark, monkeypatch, few, least, pairs):
    """Images go by cells from ``few`` points on; places missing, not a number, and images without an id are noise."""
    monkeypatch.setattr(regions, "PAIRS", pairs)
    monkeypatch.setattr(regions, "FEW", few)
    rng = random.Random(least)
    images = {1: [(rng.random(), rng.random()) for _ in range(120)], 2: [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(90)] + [(0.3, 0.3)] * 9, 3: [(i * 0.05, (i % 2) * 0.01) for i in range(-40, 40)], 4: [(1.0, 2.0)]}
    odd = [(5, 0, None, 1.0), (5, 1, float("nan"), 1.0), (5, 2, float("nan"), 1.0), (None, 0, 1.0, 1.0), (None, 1, 1.0, 1.0)]
    rows = [(i, n, *p) for i, ps in images.items() for n, p in enumerate(ps)]
    found = regions.clustered(spark.createDataFrame([*rows, *odd], "image_id int, point_no int, x double, y double").repartition(3), 0.05, least).collect()
    got = {(r.image_id, r.point_no): r.region for r in found}
    assert len(found) == len(rows) + 5 and [got.pop(o[:2]) for o in odd] == [-1] * 5
    assert got == {(i, n): r for i, ps in images.items() for n, r in enumerate(plain_regions(ps, 0.05, least))}


def test_labels_are_shuffled_once(spark, monkeypatch):
    """Regions of labels are found in one exchange of the blocks (and one of the sizes); they are those found by cells."""
    rng = random.Random(8)
    rows = [(i if i < 9 else None, n, f"t{i}.{n}", rng.random() * 400, rng.random() * 400 if n else None) for i in range(10) for n in range(14)]
    held = spark.createDataFrame(rows, "image_id int, block_no int, text string, cx double, cy double").selectExpr("*", "struct(cx - 1 AS x1, cy - 1 AS y1, cx + 1 AS x2, cy + 1 AS y2) AS rect")
    images = spark.createDataFrame([(i, 700.0 if i != 3 else None, 700.0) for i in range(7)], "image_id int, width double, height double")
    found = regions.label_regions(held, images)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = found.collect()
    monkeypatch.setattr(regions, "FEW", 10)
    assert sorted(map(str, regions.label_regions(held, images).collect())) == sorted(map(str, want))
    assert len({r.region for r in want if r.image_id == 1}) > 2 and [r.region for r in want if r.image_id in (3, 8, None)] == [0] * 3


def test_regions_run_no_python(spark):
    found = regions.clustered(tables.points(spark, SF), 0.05)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_lone_box_has_infinite_space(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0)], "image_id int, box_no int, x1 double, y1 double, x2 double, y2 double")
    r = blocks.clear_space(df, 2.0).first()
    assert r.above_mm == r.below_mm == r.left_mm == r.right_mm == float("inf")


def test_image_files_and_data_urls(spark, tmp_path):
    for name in ("a.PNG", "b.jpeg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert files.image_files(spark, str(tmp_path)).count() == 2
    r = spark.range(1).select(files.from_data_url(F.lit("data:x;base64,aGk=")).alias("a"), files.from_data_url(F.lit("aGk=")).alias("b"), files.from_data_url(F.lit("%%")).alias("c")).first()
    assert (bytes(r.a), bytes(r.b), r.c) == (b"hi", b"hi", None)


def test_damaged_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,one,1.5\n2,two,x\n3\n4,four,4.5,more\n5,five,5.5\n")
    rows = scans_of_files.read_csv(spark, str(tmp_path / "a.csv"), "n int, name string, x double")
    assert sorted(map(tuple, scans_of_files.sound(rows).collect())) == [(1, "one", 1.5), (5, "five", 5.5)]
    assert sorted(r.n for r in scans_of_files.sound(rows).select("n").collect()) == [1, 5]
    assert sorted(map(tuple, scans_of_files.quarantined(rows).collect())) == [("a.csv", "2,two,x"), ("a.csv", "3"), ("a.csv", "4,four,4.5,more")]
    spark.range(9).selectExpr("id AS n", "'x' AS name").write.orc(str(tmp_path / "o"))
    held = scans_of_files.read_orc(spark, str(tmp_path / "o"), "n long, name string").where("n > 5").select("n")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan and "ReadSchema: struct<n:bigint>" in plan and held.count() == 3


def test_lines_of_word_lists_are_those_of_words(spark):
    word = "struct<word_no:int,text:string,left:double,top:double,width:double,height:double,conf:double>"
    lists = [(i, 0, 0, 0, n, [(w, t, w * 5.0, 1.0, 4.0, 9.0, c) for w, t, c in held]) for i, n, held in [
        (1, 0, [(1, "b", 50.0), (0, "a", 90.0), (2, " ", 80.0)]), (1, 1, [(0, "x", 0.0)]), (1, 2, []), (2, 0, [(3, "d", 60.0), (0, "a", 70.0)]), (2, 0, [(1, "b", 40.0)]), (None, 0, [(0, "n", 50.0)]), (None, 0, [(1, "m", 60.0)]), (3, 0, [(0, "low", 5.0)])]]
    rows = spark.createDataFrame(lists, f"image_id long, page_num int, block_num int, par_num int, line_num int, words array<{word}>")
    got = blocks.lines_of_word_lists(rows)
    want = blocks.lines_of_words(rows.selectExpr("* EXCEPT (words)", "inline(words)"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 3
