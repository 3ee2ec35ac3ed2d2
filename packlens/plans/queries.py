"""The registered queries of the library; the SQL that checks them is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checked, geometry, gtin, text
from ..operators import blocks, boosting, model, packages, readings, registry, rules, scoring
from ..operators import regions as areas
from ..sources import scans_of_files, sinks, sql_front, tables
from ..sources.shared import new_folder, written
from ..streaming import scans, sessions
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def image_audit(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return rules.with_results(tables.packages(spark, sf_dir), wide=wide)


# --- reader output -----------------------------------------------------------------------


@query
def ocr_lines(spark, sf_dir):
    found = blocks.lines_of_word_lists(tables.word_lists(spark, sf_dir))
    return found.select(*blocks.LINE_KEYS, "text", F.round("confidence", 9).alias("confidence"), "x1", "y1", "x2", "y2")


@query
def ocr_confident_words(spark, sf_dir):
    held = blocks.confident_words(tables.words(spark, sf_dir))
    return held.groupBy("image_id").agg(F.count("*").alias("words"), F.sum("conf").alias("conf"))


@query
def ocr_blocks(spark, sf_dir):
    held = blocks.with_rect(blocks.finished_blocks(tables.lines(spark, sf_dir)))
    scaled = geometry.scaled(F.col("bbox"), F.lit(2.0), F.lit(4.0))
    return held.select("image_id", "block_no", "text", "reading_no", F.round("height_px", 6).alias("height_px"), F.round("width_px", 6).alias("width_px"), "cx", "cy", "rect.x1", "rect.y1", "rect.x2", "rect.y2", F.get(scaled, F.lit(2))["x"].alias("sx"), F.get(scaled, F.lit(2))["y"].alias("sy"))


@query
def ocr_full_text(spark, sf_dir):
    held = blocks.full_text(blocks.finished_blocks(tables.lines(spark, sf_dir)))
    return held.select("image_id", "text", F.round("average_confidence", 9).alias("average_confidence"), "total_blocks")


@query
def ocr_distinct_boxes(spark, sf_dir):
    return blocks.distinct_boxes(tables.boxes(spark, sf_dir)).select("image_id", "box_no", F.round("confidence", 6).alias("confidence"))


@query
def symbol_dedup(spark, sf_dir):
    return blocks.distinct_symbols(tables.symbols(spark, sf_dir)).select("image_id", "symbol_no", "class_name", F.round("confidence", 6).alias("confidence"))


@query
def symbol_flags(spark, sf_dir):
    return blocks.symbol_flags(tables.symbols(spark, sf_dir))


@query
def commodity_name(spark, sf_dir):
    return blocks.commodity_names(blocks.finished_blocks(tables.lines(spark, sf_dir)))


# --- text ---------------------------------------------------------------------------------


@query
def text_normalised(spark, sf_dir):
    return tables.label_texts(spark, sf_dir).select("image_id", text.lenient_text(F.col("text")).alias("text"))


@query
def label_declarations(spark, sf_dir):
    d = F.col("d")
    held = tables.label_texts(spark, sf_dir).withColumn("d", text.declarations(F.col("text")))
    return held.select(
        "image_id", d["quantity"]["value"].alias("quantity"), d["quantity"]["unit"].alias("unit"), d["fssai_license"].alias("licence"), d["dates"]["made"].alias("made"), d["dates"]["expires"].alias("expires"),
        d["dates"]["best_before"].alias("best_before"), d["care"]["phone"].alias("phone"), d["care"]["email"].alias("email"), d["scripts"]["hindi"].alias("hindi"), d["scripts"]["english"].alias("english"))


@query
def label_prices(spark, sf_dir):
    p = F.col("p")
    held = tables.label_texts(spark, sf_dir).withColumn("p", text.price(text.lenient_text(F.col("text"))))
    return held.select("image_id", p["value"].alias("mrp"), p["raw"].alias("raw"), text.says_tax_included(p["raw"]).alias("tax"))


@query
def label_parties(spark, sf_dir):
    p = F.col("p")
    held = tables.label_texts(spark, sf_dir).withColumn("p", text.parties(text.lenient_text(F.col("text"))))
    return held.select("image_id", *[p[r][f].alias(f"{r}_{f}") for r in ("manufacturer", "packer", "importer") for f in ("name", "address")])


@query
def document_contacts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    care = text.consumer_care(F.col("text"))
    return docs.select("doc_id", care.alias("c")).select("doc_id", "c.phone", "c.email")


@query
def document_scripts(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.scripts(F.col("text")).alias("s")).select("doc_id", "s.hindi", "s.english")


@query
def report_strings(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    t = F.concat(F.lit("₹ “a” – b… "), F.col("text"))
    return docs.select("doc_id", text.report_text(t).alias("latin"), text.shortened(F.col("text"), 40).alias("short"), text.masked(F.sha2("text", 256)).alias("masked"), text.safe_id(F.regexp_replace("text", "[ .,]", "-")).alias("safe"), text.number_of(F.concat(F.lit("Rs. "), F.col("n_chars").cast("string"), F.lit("/-"))).alias("number"))


# --- codes --------------------------------------------------------------------------------


@query
def gtin_facts(spark, sf_dir):
    codes = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("package_id"), tables.barcode_of(tables.key()).alias("code")).where("code is not null")
    return gtin.classified(codes).select("package_id", "gtin.digits", "gtin.length", "gtin.format", "gtin.is_gtin_length", "gtin.checksum_valid", "gtin.prefix", "gtin.country", "gtin.is_india", "gtin.is_restricted", "gtin.restricted_reason", "gtin.gtin14", "gtin.is_valid", F.array_join("gtin.notes", " | ").alias("notes"))


@query
def scanner_codes(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("EAN13", "UPCA", "QRCODE", "CODE128", "EAN8", "UPCE", "ITF")))
    codes = part.select(F.col("p_partkey").alias("package_id"), F.coalesce(tables.barcode_of(tables.key()), F.lit("")).alias("code"), F.get(kinds, (tables.key() % 7).cast("int")).alias("kind"))
    return gtin.with_scanner_economy(codes).select("package_id", "code", "kind", "economy", gtin.symbol_is_valid(F.col("code"), F.col("kind")).alias("valid"))


@query
def first_codes(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("scan_no"), F.get_json_object("props", "$.k").alias("code"))
    return packages.first_codes(seen)


# --- registries ---------------------------------------------------------------------------


def all_records(spark, sf_dir) -> DataFrame:
    payloads = tables.registry_payloads(spark, sf_dir)
    parts = [registry.facts_records(payloads.where("source = 'open_food_facts'")), registry.upc_records(payloads.where("source = 'upcitemdb'")), registry.national_records(payloads.where("source = 'gs1_india_datakart'"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query
def registry_records(spark, sf_dir):
    r = all_records(spark, sf_dir)
    return r.select("gtin", "source", "product_name", "brand", "manufacturer_name", "country_of_origin", "net_quantity_raw", "net_quantity_value", "net_quantity_unit", "mrp_value", "veg_non_veg", "ingredients", F.array_join("categories", "|").alias("categories"), F.array_join("image_urls", "|").alias("image_urls"))


@query
def registry_merge(spark, sf_dir):
    m = registry.merged_records(all_records(spark, sf_dir))
    fields = F.col("field_sources")
    return m.select("gtin", "product_name", "brand", "manufacturer_name", "country_of_origin", "net_quantity_raw", "net_quantity_value", "net_quantity_unit", "mrp_value", "veg_non_veg", F.array_join("sources", "|").alias("sources"), "found",
                    fields["product_name"].alias("from_name"), fields["brand"].alias("from_brand"), fields["mrp_value"].alias("from_mrp"), F.array_join("categories", "|").alias("categories"), F.array_join("image_urls", "|").alias("image_urls"))


@query
def registry_gap_fill(spark, sf_dir):
    m = registry.merged_records(all_records(spark, sf_dir))
    part = tables.table(spark, sf_dir, "part")
    readings = part.where("p_partkey % 2 = 1").select(F.lpad(tables.key().cast("string"), 13, "0").alias("gtin"), F.concat(F.lit("Read "), F.col("p_name")).alias("commodity_name"), F.col("p_retailprice").alias("mrp_value"), F.lit("").alias("manufacturer_name"), F.lit("2024").alias("manufacture_date"))
    f = registry.fill_gaps(m, readings)
    return f.select("gtin", "product_name", "mrp_value", "manufacturer_name", F.array_join("sources", "|").alias("sources"), F.col("field_sources")["product_name"].alias("from_name"), F.col("field_sources")["mrp_value"].alias("from_mrp"))


@query
def code_variants(spark, sf_dir):
    codes = tables.table(spark, sf_dir, "part").select(F.lpad(tables.key().cast("string"), 12, "0").alias("gtin"))
    return registry.code_variants(codes)


@query
def registry_packages(spark, sf_dir):
    facts = gtin.classified(registry.merged_records(all_records(spark, sf_dir)).withColumnRenamed("gtin", "code")).withColumnRenamed("gtin", "code_facts").withColumnRenamed("code", "gtin")
    for c in ("importer_name", "importer_address"):
        if c not in facts.columns:
            facts = facts.withColumn(c, F.lit(None).cast("string"))
    p = packages.packages_from_records(facts)
    return p.select("gtin", "commodity_name", "net_quantity_value", "net_quantity_unit", "net_quantity_category", "is_imported", "has_veg_nonveg_symbol", "barcode_gtin_format", "barcode_checksum_valid", "barcode_registered_owner", "product_identified")


# --- geometry and schedules ---------------------------------------------------------------


@query
def clear_space(spark, sf_dir):
    found = blocks.clear_space(tables.boxes(spark, sf_dir), 2.5)
    return found.select("image_id", "box_no", *[F.when(F.col(f"{s}_mm") != float("inf"), F.round(f"{s}_mm", 6)).alias(f"{s}_mm") for s in ("above", "below", "left", "right")])


@query
def font_metrics(spark, sf_dir):
    held = blocks.finished_blocks(tables.lines(spark, sf_dir)).withColumn("pixels_per_mm", geometry.calibrated(F.lit(500.0), (F.col("image_id") % 4) * 25.0)).where("pixels_per_mm is not null")
    area, quantity = F.pmod(F.col("image_id"), F.lit(30)) * 100.0, F.pmod(F.col("block_no"), F.lit(5)) * 100.0
    m = blocks.font_metrics(held, geometry.least_height(area, quantity))
    return m.select("image_id", "block_no", F.round("height_mm", 2).alias("height_mm"), F.round("width_mm", 2).alias("width_mm"), "least_mm", "meets")


@query
def panel_rules(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    area = (F.col("p_size") * F.col("p_size") * 10.0).cast("double")
    a, b = F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0
    return part.select(F.col("p_partkey").alias("package_id"), geometry.least_height(area).alias("least_mm"), geometry.least_height(area, F.col("p_size") * 10).alias("least_small_mm"), geometry.contrast(a, b).alias("contrast"), F.when(F.col("p_partkey") % 2 == 0, area / (5.0 * 5.0)).otherwise(area).alias("panel_area"))


@query
def ruler(spark, sf_dir):
    item = tables.table(spark, sf_dir, "lineitem")
    ticks = item.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 10 + F.col("l_quantity") % 4).cast("double").alias("x")).distinct()
    return blocks.ruler_pixels_per_mm(ticks).select("image_id", F.round("pixels_per_mm", 9).alias("pixels_per_mm"), "ticks")


@query
def calibrations(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    k = tables.key()
    best = geometry.best_calibration(F.when(k % 5 == 0, (k % 7).cast("double")), F.col("p_size") * 10.0, F.when(k % 3 == 0, (k % 4) * 25.0), (k % 90).cast("double"), k % 2 == 0)
    held = part.select(k.alias("package_id"), (F.col("p_size") * 100.0).alias("area"), best.alias("c"))
    return held.select("package_id", F.round("c.pixels_per_mm", 9).alias("pixels_per_mm"), "c.method", "c.confidence", F.round(geometry.panel_area_mm2(F.col("area"), F.col("c.pixels_per_mm")), 6).alias("panel_mm2"))


@query
def least_heights(spark, sf_dir):
    held = blocks.finished_blocks(tables.lines(spark, sf_dir)).withColumn("h", F.round(F.col("height_px") / 4.0 - 3.0, 2))
    return held.groupBy("image_id").agg(F.min(F.when(F.col("h") > 0, F.col("h"))).alias("min_font_height_mm"))


@query
def regions(spark, sf_dir):
    held = areas.region_boxes(areas.clustered(tables.points(spark, sf_dir), 0.05))
    return held.select("image_id", "region", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "points")


@query
def label_regions(spark, sf_dir):
    """Text regions of the documents' lines as label images; every seventh image has no known size."""
    held = blocks.with_rect(blocks.finished_blocks(tables.lines(spark, sf_dir)))
    return areas.label_regions(held, tables.image_sizes(held))


@query
def single_regions(spark, sf_dir):
    held = blocks.with_rect(blocks.finished_blocks(tables.lines(spark, sf_dir)))
    return areas.single_region(held, tables.image_sizes(held))


@query
def permitted_errors(spark, sf_dir):
    cases = tables.error_cases(spark, sf_dir).withColumn("e", geometry.permitted_error(F.col("declared"), F.col("category")))
    short = F.col("declared") - F.col("actual")
    return cases.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "declared", F.round(short, 6).alias("deficiency"), F.round("e.limit", 6).alias("limit_value"), F.col("e.basis").alias("basis"), (short <= F.col("e.limit")).alias("complies"))


@query
def standard_quantities(spark, sf_dir):
    from ..functions import fixed

    part = tables.table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, [*sorted(fixed.STANDARD_QUANTITIES), "unknown"]))
    kind, quantity = F.get(names, (F.col("p_partkey") % 17).cast("int")), (F.col("p_size") * 25.0).cast("double")
    return part.select(F.col("p_partkey").alias("package_id"), kind.alias("kind"), F.coalesce(F.array_contains(geometry.standard_quantities(kind), quantity), F.lit(False)).alias("standard"), geometry.nearest_standard(kind, quantity).alias("nearest"))


@query
def unit_table(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, ("GMS", " Kg.", "ltr", "cl", "tablets", "SqM", "nos", "mm", "Milliliter", "U")))
    raw = F.get(names, (F.col("p_partkey") % 10).cast("int"))
    return part.select(F.col("p_partkey").alias("package_id"), packages.unit_and_category(raw).alias("u"), text.label_unit(raw).alias("label_unit")).select("package_id", "u.unit", "u.category", "label_unit")


# --- packages ------------------------------------------------------------------------------


@query
def package_table(spark, sf_dir):
    p = tables.packages(spark, sf_dir)
    return p.select("package_id", "analysis_source", "commodity_name", "manufacturer_address", "country_of_origin", "net_quantity_value", "net_quantity_unit", "net_quantity_category", "mrp_value", "manufacture_date", "is_imported", "barcode_value", "barcode_gtin_format", "barcode_checksum_valid", "barcode_country", "barcode_is_restricted")


@query
def label_packages(spark, sf_dir):
    labels = tables.label_texts(spark, sf_dir).withColumn("declarations", text.declarations(F.col("text")))
    p = packages.packages_from_labels(labels)
    return p.select("image_id", "net_quantity_value", "net_quantity_unit", "net_quantity_category", "is_imported", "has_english_text", "best_before")


@query
def code_packages(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("scan_no"), F.get_json_object("props", "$.k").alias("code"))
    return packages.attach_codes(tables.packages(spark, sf_dir), packages.first_codes(seen)).select("package_id", "barcode_value", "has_barcode")


@query
def declared_packages(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    k = tables.key()
    rows = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("commodity_name").alias("field"), F.col("p_name").alias("value"), F.lit("").alias("raw")),
        F.struct(F.lit(1).alias("seq"), F.lit("net_quantity").alias("field"), F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, " gms").otherwise("Ltr.")).alias("value"), F.lit("").alias("raw")),
        F.struct(F.lit(2).alias("seq"), F.lit("mrp").alias("field"), F.concat(F.lit("Rs "), F.format_string("%.2f", F.col("p_retailprice")), F.lit("/-")).alias("value"), F.when(k % 3 == 0, "inclusive of all taxes").otherwise("MRP").alias("raw")))
    declared = part.select(k.alias("package_id"), F.explode(rows).alias("d")).select("package_id", "d.*")
    return packages.apply_declarations(declared)


@query
def reading_packages(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    k = tables.key()
    d = F.struct(F.col("p_retailprice").alias("mrp_value"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("net_quantity_value"), F.lit("g").alias("net_quantity_unit"), F.lit("05/24").alias("dates"), F.when(k % 3 == 0, "01/24").alias("manufacture_date"), F.lit("care").alias("consumer_care"), F.when(k % 4 == 0, tables.barcode_of(k)).alias("barcode_printed"))
    answer = F.to_json(F.struct(F.when(k % 5 != 0, F.col("p_name")).alias("product_name"), d.alias("declarations")))
    return packages.packages_from_readings(part.select(k.alias("package_id"), F.from_json(answer, readings.READING).alias("j")))


@query
def merged_sides(spark, sf_dir):
    p = tables.packages(spark, sf_dir)
    front = p.withColumn("commodity_name", F.when(F.col("package_id") % 2 == 0, F.col("commodity_name"))).withColumn("mrp_value", F.when(F.col("package_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("mrp_value")))
    back = p.where("package_id % 4 < 3").withColumn("commodity_name", F.lit("Back name")).withColumn("total_text_blocks", F.lit(5)).withColumn("average_ocr_confidence", F.lit(0.5))
    m = packages.merged_sides(front, back)
    return m.select("package_id", "commodity_name", "mrp_value", "mrp_includes_tax", "has_english_text", "country_of_origin", "barcode_is_gs1_india", F.round("average_ocr_confidence", 9).alias("average_ocr_confidence"), "total_text_blocks", "package_type")


@query
def attached_registry(spark, sf_dir):
    p = tables.packages(spark, sf_dir).withColumn("barcode_value", F.lpad(F.col("package_id").cast("string"), 13, "0"))
    a = packages.attach_registry(p, registry.merged_records(all_records(spark, sf_dir)))
    return a.select("package_id", "commodity_name", "manufacturer_name", "net_quantity_value", F.array_join("filled_fields", "|").alias("filled"), "product_identified")


@query
def package_features(spark, sf_dir):
    f = packages.features(tables.packages(spark, sf_dir))
    return f.withColumn("qty_clear_space_ratio", F.round("qty_clear_space_ratio", 9))


# --- rules and scores -----------------------------------------------------------------------


@query
def rule_results(spark, sf_dir):
    return rules.exploded(image_audit(spark, sf_dir)).select("package_id", "rule_no", "rule_id", "status", "severity", "weight")


@query
def rule_details(spark, sf_dir):
    wanted = ["R06_NAME", "R10_ADDRESS", "R11_NET_QTY", "R06_MRP", "R06_COO", "R09_LANG", "B01_GTIN_STRUCT", "B06_ORIGIN_CONSISTENCY"]
    held = rules.with_results(tables.packages(spark, sf_dir), rule_ids=wanted, wide=True)
    return rules.exploded(held).select("package_id", "rule_id", "rule_name", "status", "detail", "evidence", "legal_reference")


@query
def isolated_rules(spark, sf_dir):
    """Rules that need a column which a table lacks are inconclusive; the others are judged."""
    held = rules.with_results(tables.packages(spark, sf_dir).drop("mrp_value"), isolate=True, wide=True)
    return rules.exploded(held).where("rule_id IN ('R06_MRP', 'R06_NAME')").select("package_id", "rule_id", "status", "severity", "weight", F.col("detail").startswith("Rule evaluation failed with error").alias("failed"))


def unit_price_rule() -> rules.Rule:
    """A user's rule: a price by gram of at most 10, from texts that needn't be numbers, and quantities that may be 0."""
    price = checked.quotient(checked.plain(F.col("mrp_value")), checked.converted(checked.plain(F.col("declared")), "double"))
    return rules.Rule("X01_UNIT_PRICE", lambda: [
        rules.Outcome(price.value.isNull(), "NOT_APPLICABLE", "MINOR", 0.0, F.lit("No unit price.")),
        rules.Outcome(price.value > 10, "FAIL", "MAJOR", 0.5, F.concat(F.lit("Unit price "), text.two_places(price.value))),
        rules.Outcome(None, "PASS", "MAJOR", 0.5, F.lit("Unit price in bounds.")),
    ], "Unit price", lambda: [price])


@query
def checked_rules(spark, sf_dir):
    """A rule that goes wrong on some rows is inconclusive there; the other rows and rules are judged."""
    k = F.col("package_id")
    declared = F.when(k % 6 == 0, "0").when(k % 6 == 1, "ten").when(k % 6 > 2, (k % 300).cast("string"))
    held = rules.with_results(tables.packages(spark, sf_dir).withColumn("declared", declared), ["R06_MRP"], wide=True, own=[unit_price_rule()])
    return rules.exploded(held).select("package_id", "rule_no", "rule_id", "rule_name", "status", "weight", F.when(F.col("rule_id") == "X01_UNIT_PRICE", F.col("detail")).alias("detail"))


@query
def rule_summaries(spark, sf_dir):
    return image_audit(spark, sf_dir).select("package_id", rules.summary(F.col("results")).alias("summary"))


@query
def report_documents(spark, sf_dir):
    """The indented report of each package, as parsed again."""
    held = scoring.registry_scores(image_audit(spark, sf_dir))
    report = held.select("package_id", scoring.report_json("package_id", "final_score", "star_rating", "star_label", "passed_rules", "failed_rules").alias("report"))
    return report.select("package_id", F.get_json_object("report", "$.star_label").alias("label"), F.get_json_object("report", "$.passed_rules").cast("int").alias("passed"), F.size(F.split("report", "\n")).alias("n_lines"))


@query
def rule_counts(spark, sf_dir):
    held = image_audit(spark, sf_dir)
    return held.select("package_id", *rules.counts(F.col("results")), packages.weak_label(F.col("results")).alias("weak_label"))


@query
def one_rule(spark, sf_dir):
    held = rules.with_results(tables.packages(spark, sf_dir), rule_ids=["R06_MRP"])
    return rules.exploded(held).select("package_id", "rule_id", "status")


@query
def label_scores(spark, sf_dir):
    held = scoring.label_scores(image_audit(spark, sf_dir).where("analysis_source = 'image'"), F.lit(0.5))
    return held.select("package_id", F.round("rule_score", 9).alias("rule_score"), F.round("final_score", 9).alias("final_score"), "star_rating", "star_label", "total_applicable_rules", "passed_rules", "failed_rules", "critical_failures", "major_failures", "minor_failures")


@query
def registry_scores(spark, sf_dir):
    held = scoring.registry_scores(image_audit(spark, sf_dir).where("analysis_source = 'barcode_registry'"))
    return held.select("package_id", "final_score", "star_rating", "star_label", "total_applicable_rules", "passed_rules", "failed_rules", "critical_failures", "unverified", "predicted_compliant", F.array_join("top_risk_factors", "|").alias("risks"))


@query
def recommendations(spark, sf_dir):
    held = image_audit(spark, sf_dir, wide=True)
    return held.select("package_id", F.posexplode(scoring.recommendations(F.col("results"))).alias("line_no", "line"))


@query
def registry_recommendations(spark, sf_dir):
    held = image_audit(spark, sf_dir, wide=True).where("analysis_source = 'barcode_registry'")
    lines = scoring.registry_recommendations(F.col("results"), F.col("product_identified"))
    return held.select("package_id", F.get(lines, F.lit(0)).alias("first_line"), F.size(lines).alias("n_lines"))


@query
def report_table(spark, sf_dir):
    rows = scoring.report_rows(rules.exploded(image_audit(spark, sf_dir, wide=True)))
    return rows.select("package_id", "bucket_no", "rule_no", "id_cell", "name_cell", "status")


@query
def severity_failures(spark, sf_dir):
    rows = rules.exploded(image_audit(spark, sf_dir))
    return rows.cube("status", "severity").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query
def training_log(spark, sf_dir):
    rows = rules.exploded(image_audit(spark, sf_dir).where("analysis_source = 'image'")).where("status = 'FAIL'")
    return rows.groupBy("severity", "rule_id").agg(F.count("*").alias("failures"))


@query
def reports(spark, sf_dir):
    held = scoring.registry_scores(image_audit(spark, sf_dir, wide=True))
    return held.select("package_id", F.to_json(scoring.payload()).alias("report"))


@query
def console_reports(spark, sf_dir):
    held = scoring.registry_scores(image_audit(spark, sf_dir, wide=True))
    shown = held.select("package_id", scoring.console_report(F.col("package_id").cast("string"), scoring.recommendations(F.col("results"))).alias("report"))
    lines = F.split("report", "\n")
    return shown.select("package_id", F.array_join(F.slice(lines, 1, 6), "\n").alias("head"), F.size(lines).alias("n_lines"), F.element_at(lines, -1).alias("foot"))


@query
def report_cells(spark, sf_dir):
    held = scoring.registry_scores(image_audit(spark, sf_dir))
    images = F.concat_ws(" + ", F.lit("front.jpg"), F.when(F.col("package_id") % 2 == 0, "back.jpg"), F.when(F.col("has_barcode"), F.concat(F.lit("(barcode "), "barcode_value", F.lit(")"))))
    none_left = F.size(rules.bucket(F.col("results"), "NOT_APPLICABLE")) + F.size(rules.bucket(F.col("results"), "INCONCLUSIVE"))
    mode = scoring.analysis_mode(F.create_map(F.when(F.col("analysis_source") == "image", "ocr").otherwise("barcode_registry_analysis"), F.lit(1.0)))
    return held.select("package_id", scoring.percent_text(F.col("final_score")).alias("percent"), scoring.star_text(F.col("star_rating")).alias("stars"), images.alias("images"), none_left.alias("not_judged"), mode.alias("mode"), F.round(F.col("final_score") * 100, 1).alias("points"))


@query
def model_readings(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    k = tables.key()
    status = F.array(*map(F.lit, ("pass", "FAIL", "warning", "odd", "not_applicable")))
    rule = lambda i: F.struct(F.lit(f"L{i}").alias("rule_id"), F.get(status, ((k + i) % 5).cast("int")).alias("status"), F.when((k + i) % 3 == 0, "critical").when((k + i) % 3 == 1, "major").alias("severity"))
    score = F.when(k % 3 == 0, F.col("p_size") * 2.0).when(k % 3 == 1, F.col("p_size") / 50.0).otherwise(0.0)
    body = F.struct(score.alias("compliance_score"), F.array(rule(0), rule(1), rule(2), rule(3)).alias("rules"))
    raw = F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```"))
    parsed = part.select(k.alias("package_id"), F.from_json(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), readings.READING).alias("j"))
    shaped = F.transform("j.rules", lambda r: F.struct(r["rule_id"].alias("rule_id"), F.upper(F.coalesce(r["status"], F.lit("INCONCLUSIVE"))).alias("status"), F.upper(F.coalesce(r["severity"], F.lit("MINOR"))).alias("severity"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight")))
    held = scoring.reading_scores(parsed.select("package_id", F.col("j.compliance_score").alias("compliance_score"), shaped.alias("results")))
    return held.select("package_id", "final_score", "star_rating", "star_label", "passed_rules", "failed_rules", "critical_failures", "major_failures", "minor_failures")


@query
def fallback_readings(spark, sf_dir):
    """Of each request the first answer that can be read, and its score; else what went wrong last."""
    held = readings.first_readings(tables.model_answers(spark, sf_dir))
    scored = scoring.reading_scores(held.select("*", F.col("j.compliance_score").alias("compliance_score")))
    shown = F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["rule_id"], r["rule_name"], r["status"], r["severity"])), "|")
    return scored.select("request_id", "model_no", "error", F.col("j.product_name").alias("product_name"), shown.alias("rules"), F.when(F.col("error").isNull(), F.col("final_score")).alias("final_score"))


@query
def knowledge_records(spark, sf_dir):
    return registry.knowledge_records(tables.knowledge_payloads(spark, sf_dir))


@query
def knowledge_labels(spark, sf_dir):
    return registry.knowledge_labels(tables.knowledge_payloads(spark, sf_dir))


@query
def malformed_payloads(spark, sf_dir):
    return registry.malformed(tables.knowledge_payloads(spark, sf_dir)).select("gtin", "source", "reason")


@query
def data_urls(spark, sf_dir):
    from ..sources.files import from_data_url

    pages = tables.table(spark, sf_dir, "pages")
    url = F.concat(F.when(F.col("page_id") % 2 == 0, "data:text/html;base64,").otherwise(""), F.base64(F.encode("url", "UTF-8")))
    return pages.select("page_id", F.decode(from_data_url(url), "UTF-8").alias("url"))


# --- from SQL text ----------------------------------------------------------------------------


def asked(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql_front.register(spark, sf_dir)
    return spark.sql(sql)


@query
def sql_gtin_facts(spark, sf_dir):
    return asked(spark, sf_dir, "SELECT package_id, f.* EXCEPT (notes), array_join(f.notes, ' | ') AS notes FROM (SELECT package_id, gtin_facts(code) AS f FROM codes)")


@query
def sql_declarations(spark, sf_dir):
    return asked(spark, sf_dir, """
        WITH t AS (SELECT image_id, label_text(text) AS text FROM label_texts),
        d AS (SELECT image_id, label_quantity(text) AS q, label_licence(text) AS licence, label_dates(text) AS dates, label_contact(text) AS care, has_hindi(text) AS hindi, has_english(text) AS english FROM t)
        SELECT image_id, q.value AS quantity, q.unit AS unit, licence, dates.made AS made, dates.expires AS expires, dates.best_before AS best_before, care.phone AS phone, care.email AS email, hindi, english FROM d""")


@query
def sql_label_lines(spark, sf_dir):
    """A table function joined to each label: lines with a price or a quantity."""
    return asked(spark, sf_dir, "SELECT image_id, line_no, line, label_price(line) AS price, label_quantity(line).value AS quantity FROM label_texts, LATERAL label_lines(text)")


@query
def sql_audit(spark, sf_dir):
    return asked(spark, sf_dir, """
        SELECT a.analysis_source, r.rule_id, r.status, count(*) AS n, sum(r.weight) AS weight, count_if(a.weak_label = 0) AS rejected
        FROM audits a, LATERAL rule_rows(a.results) r GROUP BY ALL""")


# --- model and stream: no SQL --------------------------------------------------------------


def made_rows(spark, sf_dir) -> DataFrame:
    """A synthetic feature row for each part."""
    return model.synthetic_rows(tables.table(spark, sf_dir, "part"), "p_partkey")


@query
def synthetic_training_rows(spark, sf_dir):
    rows = made_rows(spark, sf_dir)
    sums = [F.round(F.sum(f), 3).alias(f) for f in ("mrp_font_height_mm", "min_font_height_mm", "panel_area_mm2", "mrp_value")]
    counts = [F.count(f).alias(f"n_{f}") for f in ("mrp_font_height_mm", "net_qty_font_height_mm", "mrp_contrast_ratio")]
    return rows.groupBy("label", "has_mrp", "has_english").agg(F.count("*").alias("n"), F.sum("num_declarations_found").alias("declarations"), *sums, *counts)


def labelled_rows(spark, sf_dir) -> DataFrame:
    """Features of audited label packages with weak labels, and synthetic rows."""
    audited = image_audit(spark, sf_dir).where("analysis_source = 'image'").withColumn("label", packages.weak_label(F.col("results")))
    real = packages.features(audited, more=["label"]).withColumn("origin", F.lit("real"))
    made = made_rows(spark, sf_dir).withColumnRenamed("row_id", "package_id").withColumn("origin", F.lit("synthetic"))
    return real.unionByName(made, allowMissingColumns=True)


@query
def training_rows(spark, sf_dir):
    both = labelled_rows(spark, sf_dir)
    return both.groupBy("origin", "label").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("origin")), 9))


#: Rounds and bags of the registered queries; a model for use is worth more of both.
TRAINING = boosting.Boosting(rounds=15, rate=0.3, bags=4, pair_rounds=5)


@query
def additive_model(spark, sf_dir):
    fitted = model.fit(labelled_rows(spark, sf_dir), how=TRAINING)
    scored = model.predicted(packages.features(tables.packages(spark, sf_dir)), fitted)
    return scored.select("package_id", "probability", "predicted", F.array_join("risk_factors", "|").alias("risk_factors"))


@query
def model_importances(spark, sf_dir):
    rows = written(labelled_rows(spark, sf_dir), "labelled")
    return model.top_importances(model.predicted(rows, model.fit(rows, how=TRAINING)))


@query
def model_scores(spark, sf_dir):
    """Label audits scored with the trained model's probability."""
    audited = image_audit(spark, sf_dir).where("analysis_source = 'image'")
    scored = model.predicted(packages.features(audited, more=["results"]), model.fit(labelled_rows(spark, sf_dir), how=TRAINING)).withColumn("risks", F.array_join("risk_factors", "|"))
    held = scoring.label_scores(scored, F.col("probability"))
    return held.select("package_id", "probability", "rule_score", "final_score", "star_rating", "star_label", "passed_rules", "failed_rules", "critical_failures", "risks")


#: A model that is written down, with a pair, for scoring by a given model.
GIVEN_MODEL = model.AdditiveModel(
    {"has_mrp": [0.0], "mrp_font_height_mm": [1.0, 2.5], "num_declarations_found": [5.0, 8.0]}, {"has_mrp": [-1.5, 0.5, 0.0], "mrp_font_height_mm": [-0.75, 0.25, 0.5, -0.25], "num_declarations_found": [-1.0, 0.125, 0.75, 0.0]}, 0.25,
    [model.PairTerm("has_mrp", "mrp_value", [0.0], [1000.0, 1400.0], [-0.5, -0.25, 0.0, -0.125, 0.0, 0.125, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0])],
)


@query
def given_model_scores(spark, sf_dir):
    audited = image_audit(spark, sf_dir).where("analysis_source = 'image'")
    scored = model.predicted(packages.features(audited), GIVEN_MODEL).select("package_id", "probability", "predicted", "risk_factors", "contributions")
    held = scoring.label_scores(audited.join(scored, "package_id"), F.col("probability"))
    return held.select("package_id", F.round("probability", 9).alias("probability"), "predicted", F.array_join("risk_factors", "|").alias("risks"), F.round(F.col("contributions")["has_mrp & mrp_value"], 9).alias("pair"), F.round("final_score", 9).alias("final_score"), "star_label")


@query
def scan_facts(spark, sf_dir):
    held = scans.verified_scans(scans.scans_of(tables.table(spark, sf_dir, "events")))
    return held.select("event_id", "device", "code", "gtin.format", "gtin.country", "gtin.is_valid")


@query
def scans_per_minute(spark, sf_dir):
    held = scans.scans_per_minute(scans.scans_of(tables.table(spark, sf_dir, "events")))
    return held.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "scans")


@query
def device_sessions(spark, sf_dir):
    held = sessions.device_sessions(scans.scans_of(tables.table(spark, sf_dir, "events")), "6 hours")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return held.select("device", F.date_format("start", stamp).alias("start"), F.date_format("end", stamp).alias("end"), "scans")


@query
def late_scans(spark, sf_dir):
    """Scans that arrive in another order than they were made, by 256."""
    arrived = tables.table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id").bitwiseXOR(F.lit(255)))
    held = sessions.late_scans(scans.scans_of(arrived))
    return held.groupBy("device").agg(F.count("*").alias("scans"), F.count_if("late").alias("late"), F.max("behind").alias("behind"))


@query
def kept_documents(spark, sf_dir):
    """Reports written as indented documents, batch by batch and one batch twice, and read back."""
    held = scoring.registry_scores(image_audit(spark, sf_dir))
    reports = held.select("package_id", scoring.report_json("package_id", "final_score", "star_rating", "star_label", "passed_rules", "failed_rules").alias("report"))
    reports, folder = written(reports, "reports"), new_folder(spark, "documents")
    for batch in (0, 1, 1):
        sinks.write_documents(reports.where(F.col("package_id") % 2 == batch), folder, batch)
    kept = sinks.read_documents(spark, folder)
    return kept.select("batch", *[F.get_json_object("report", f"$.{c}").cast(kind).alias(c) for c, kind in (("package_id", "long"), ("star_label", "string"), ("passed_rules", "int"))], F.size(F.split("report", "\n")).alias("n_lines"))


PART_FIELDS = "p_partkey long, p_name string, p_size int, p_retailprice double"


def part_lines(spark, sf_dir) -> DataFrame:
    """The parts written as CSV, of which some lines are damaged, and read back."""
    part, k = tables.table(spark, sf_dir, "part"), tables.key()
    line = F.to_csv(F.struct(k, F.col("p_name"), F.when(k % 50 == 0, "large").otherwise(F.col("p_size").cast("string")), F.col("p_retailprice")))
    folder = new_folder(spark, "lines")
    part.select(F.when(k % 50 == 1, k.cast("string")).when(k % 50 == 2, F.concat(line, F.lit(",more"))).otherwise(line).alias("value")).write.text(folder)
    return scans_of_files.read_csv(spark, folder, PART_FIELDS)


@query
def csv_scan(spark, sf_dir):
    return scans_of_files.sound(part_lines(spark, sf_dir)).where("p_size > 10")


@query
def quarantined_lines(spark, sf_dir):
    return scans_of_files.quarantined(part_lines(spark, sf_dir)).select("line")


@query
def orc_scan(spark, sf_dir):
    folder = new_folder(spark, "orc")
    tables.table(spark, sf_dir, "part").write.orc(folder)
    return scans_of_files.read_orc(spark, folder, PART_FIELDS + ", p_colour string").where("p_size > 10")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
