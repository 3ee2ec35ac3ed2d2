"""Hand-derived audits, and properties that hold for every package."""

import pytest
from pyspark.sql import functions as F

from packlens.functions import checked, gtin
from packlens.operators import packages, rules, scoring
from packlens.sources import tables

SF = "/root/testdata/sf0.001"
PACKAGE = """package_id long, analysis_source string, commodity_name string, manufacturer_name string, manufacturer_address string, packer_name string, packer_address string, importer_name string, importer_address string,
country_of_origin string, net_quantity_value double, net_quantity_unit string, net_quantity_category string, mrp_value double, mrp_includes_tax boolean, mrp_altered boolean, manufacture_date string, best_before string, expiry_date string,
consumer_care_name string, consumer_care_phone string, consumer_care_email string, mrp_font_height_mm double, net_qty_font_height_mm double, mrp_contrast_ratio double, net_qty_contrast_ratio double,
net_qty_clear_space_above_mm double, net_qty_clear_space_below_mm double, net_qty_clear_space_left_mm double, net_qty_clear_space_right_mm double, principal_display_panel_area_mm2 double, barcode_value string,
barcode_gtin_format string, barcode_checksum_valid boolean, barcode_country string, barcode_is_gs1_india boolean, barcode_is_restricted boolean, barcode_restricted_reason string, barcode_registered_owner string, product_data_sources array<string>"""
DEFAULTS = {"average_ocr_confidence": 0.0, "declarations_on_principal_panel": False, "has_hindi_text": False, "has_english_text": False, "is_imported": False, "has_barcode": False, "product_identified": False}


def package(spark, **known):
    row = [{"package_id": 1, "analysis_source": "image", **{k: v for k, v in known.items() if k not in DEFAULTS and k != "package_type"}}]
    df = spark.createDataFrame(row, PACKAGE)
    values = {**DEFAULTS, **{k: v for k, v in known.items() if k in DEFAULTS}}
    return df.withColumns({k: F.lit(v) for k, v in values.items()}).withColumn("package_type", F.lit(known.get("package_type", "retail")))


def test_code_without_registry_entry(spark):
    facts = gtin.classified(spark.createDataFrame([("8901030928239",)], "code string")).first().gtin
    assert (facts.length, facts.checksum_valid, facts.prefix, facts.country, facts.is_restricted, facts.is_valid) == (13, True, "890", "India", False, True)
    p = package(spark, analysis_source="barcode_registry", has_barcode=True, barcode_value=facts.digits, barcode_gtin_format=facts.format, barcode_checksum_valid=True, barcode_country="India", barcode_is_gs1_india=True, barcode_is_restricted=False)
    held = scoring.registry_scores(rules.with_results(p, wide=True))
    r = held.select("*", *rules.counts(F.col("results")), scoring.registry_recommendations(F.col("results"), F.col("product_identified")).alias("lines")).first()
    assert (r["pass"], r.fail, r.warning, r.not_applicable, r.inconclusive, r.total) == (5, 0, 1, 19, 13, 38)
    assert (r.final_score, r.star_rating, r.star_label) == (0.128, 1, "Critically Non-Compliant — 12 mandatory declarations unverified")
    assert (r.total_applicable_rules, r.predicted_compliant) == (18, False)
    assert [x[:12] for x in r.lines] == ["[INFO] This ", "[ACTION] 12 ", "[WARNING] Re"]


def test_empty_label(spark):
    held = scoring.label_scores(rules.with_results(package(spark)), F.lit(0.0))
    r = held.select("*", *rules.counts(F.col("results")), packages.weak_label(F.col("results")).alias("label")).first()
    assert (r["pass"], r.fail, r.warning, r.not_applicable, r.inconclusive, r.total) == (2, 9, 1, 11, 9, 32)
    assert r.rule_score == pytest.approx(1.25 / 8.75)
    assert (r.critical_failures, r.major_failures, r.minor_failures, r.label) == (5, 4, 0, 0)


CASES = [
    ("R03_SCOPE", {"net_quantity_value": 30.0, "net_quantity_unit": "KG"}, "FAIL", 0.5),
    ("R03_SCOPE", {"net_quantity_value": 30.0, "net_quantity_unit": "g"}, "PASS", 0.25),
    ("R06_NAME", {"commodity_name": ""}, "FAIL", 1.0),
    ("R10_ADDRESS", {"manufacturer_address": "Short", "packer_address": "A long enough address"}, "FAIL", 1.0),
    ("R13_UNITS", {"net_quantity_unit": "g"}, "WARNING", 0.5),
    ("R06_MRP_TAX", {"mrp_value": 1.0}, "INCONCLUSIVE", 0.5),
    ("R06_MRP_TAX", {"mrp_value": 1.0, "mrp_includes_tax": False}, "FAIL", 0.5),
    ("R06_COO", {"is_imported": True, "analysis_source": "barcode_registry"}, "FAIL", 0.5),
    ("R09_LEGIBLE", {"average_ocr_confidence": 0.4}, "PASS", 0.5),
    ("R09_CONTRAST", {"mrp_contrast_ratio": 0.0, "net_qty_contrast_ratio": 3.0}, "PASS", 0.5),
    ("R09_CONTRAST", {"mrp_contrast_ratio": 0.0}, "INCONCLUSIVE", 0.5),
    ("R07_FONT", {"mrp_font_height_mm": 1.0}, "PASS", 0.5),
    ("R07_FONT", {"mrp_font_height_mm": 2.4, "principal_display_panel_area_mm2": 50_000.0}, "FAIL", 0.5),
    ("R25_EXPORT", {"is_imported": True, "importer_name": "X"}, "FAIL", 1.0),
    ("R24_WHOLESALE", {"package_type": "wholesale", "importer_name": "X", "net_quantity_value": 0.0}, "PASS", 0.5),
    ("B03_GTIN_SCOPE", {"barcode_value": "2", "barcode_is_restricted": True}, "FAIL", 0.5),
    ("B06_ORIGIN_CONSISTENCY", {"country_of_origin": "india ", "barcode_country": "India"}, "PASS", 0.25),
    ("B06_ORIGIN_CONSISTENCY", {"country_of_origin": "Nepal", "barcode_country": "India"}, "WARNING", 0.25),
    ("B06_ORIGIN_CONSISTENCY", {"country_of_origin": "Nepal"}, "PASS", 0.25),
]


def test_single_outcomes(spark):
    for rule_id, known, status, weight in CASES:
        r = rules.with_results(package(spark, **known), rule_ids=[rule_id]).first().results[0]
        assert (r.status, r.weight) == (status, weight), (rule_id, known)


def test_clear_space_text(spark):
    sides = {f"net_qty_clear_space_{s}_mm": 1.0 for s in ("above", "below", "left", "right")}
    r = rules.with_results(package(spark, net_qty_font_height_mm=1.0, **sides), rule_ids=["R08_CLEAR"], wide=True).first().results[0]
    assert r.detail == "Insufficient clear space: left=1.0mm right=1.0mm (need ≥2.0mm)."


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError, match="no such rules"):
        rules.with_results(package(spark), rule_ids=["R99"])


def test_every_package_gets_all_rules(spark):
    held = rules.with_results(tables.packages(spark, SF))
    assert {r.n for r in held.select(F.size("results").alias("n")).distinct().collect()} <= {32, 38}


def test_results_need_no_shuffle(spark):
    p = package(spark).cache()
    plan = scoring.label_scores(rules.with_results(p), F.lit(0.5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_merge_with_itself_keeps_values(spark):
    p = tables.packages(spark, SF)
    m = packages.merged_sides(p, p).select("package_id", "commodity_name", "manufacturer_name", F.col("mrp_value").alias("v"))
    want = p.select("package_id", "commodity_name", "manufacturer_name", F.col("mrp_value").alias("v"))
    assert m.exceptAll(want).count() == 0


def test_errors_of_single_rows_stay_there(spark):
    """Under ANSI a plain division stops the query; a checked one makes its row inconclusive."""
    df = spark.createDataFrame([(1, "4", 8.0, ["a"]), (2, "0", 8.0, []), (3, "x", 8.0, ["a"]), (4, None, 8.0, None), (5, "0", None, ["a", "b"])], "package_id int, n string, m double, parts array<string>")
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.where("package_id = 2").select(F.col("m") / F.col("n").cast("double")).collect()
    share = checked.quotient(checked.plain(F.col("m")), checked.converted(checked.plain(F.col("n")), "double"))
    part = checked.element(checked.plain(F.col("parts")), 0)
    one = rules.Rule("X", lambda: [rules.Outcome(share.value > 1, "PASS", "MAJOR", 1.0, F.lit("fine")), rules.Outcome(None, "FAIL", "MAJOR", 1.0, F.lit("small"))], "Own", lambda: [share, part])
    other = rules.Rule("Y", lambda: [rules.Outcome(None, "PASS", "MINOR", 0.0, F.lit("always"))], "Other")
    got = {(r.package_id, r.rule_id): (r.status, r.detail) for r in rules.exploded(rules.with_results(df, [], wide=True, own=[one, other])).collect()}
    begin = "Rule evaluation failed with error: "
    assert [got[i, "X"] for i in range(1, 6)] == [("PASS", "fine"), ("INCONCLUSIVE", begin + "division by zero"), ("INCONCLUSIVE", begin + "no double: x"), ("FAIL", "small"), ("FAIL", "small")]
    assert all(got[i, "Y"] == ("PASS", "always") for i in range(1, 6))
    days = df.select(checked.day(checked.plain(F.lit("2024-13-01")), "yyyy-MM-dd").error.alias("e"), checked.day(checked.plain(F.lit("2024-12-01")), "yyyy-MM-dd").error.alias("f")).first()
    assert days.e == "no date: 2024-13-01" and days.f is None


def test_stamps_and_feature_types(spark):
    r = scoring.stamped(spark.range(2)).collect()
    assert all(len(x.scan_id) == 8 and int(x.scan_id, 16) >= 0 and "T" in x.scan_timestamp for x in r) and r[0].scan_id != r[1].scan_id
    types = packages.feature_types()
    assert len(types) == 27 and types["has_mrp"] == types["is_imported"] == types["on_principal_panel"] == "nominal" and types["mrp_value"] == types["num_declarations_found"] == "continuous"
