"""Adapters: packages, reader output, codes and registry payloads derived from the test tables.

Derivations are plain projections and joins, so that the same tables can be made
in any SQL engine. Readers of real inputs (files, data URLs) are in ``files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gtin import check_digit, classified

def key() -> Column:
    """The part's key, from which gaps and defects are derived."""
    return F.col("p_partkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_if(value: Column, condition: Column) -> Column:
    return F.when(~condition, value)


def barcode_of(key: Column) -> Column:
    """A code in one of eight shapes: none, wrong check digit, reserved prefix, 12, 14, 8 and 7 digits, else a correct 13."""
    body = F.concat(F.lit("890"), F.lpad(key.cast("string"), 9, "0"))
    right = F.concat(body, check_digit(body).cast("string"))
    reserved = F.concat(F.lit("2"), F.lpad(key.cast("string"), 11, "0"))
    short = F.lpad(key.cast("string"), 11, "0")
    long = F.concat(F.lit("1"), body)
    eight = F.lpad(key.cast("string"), 7, "3")
    with_check = lambda b: F.concat(b, check_digit(b).cast("string"))
    return (
        F.when(key % 13 == 0, F.lit(None).cast("string")).when(key % 13 == 1, F.concat(body, ((check_digit(body) + 1) % 10).cast("string"))).when(key % 13 == 2, with_check(reserved))
        .when(key % 13 == 3, with_check(short)).when(key % 13 == 4, with_check(long)).when(key % 13 == 5, with_check(eight)).when(key % 13 == 6, eight).otherwise(right)
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package per part, with gaps and defects by its key; bar-code facts included."""
    k = key()
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    lineitem, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "supplier"))
    first = lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("suppkey"), F.min("l_shipdate").alias("shipdate"))
    rows = part.join(first, part["p_partkey"] == first["l_partkey"], "left").join(supplier, F.col("suppkey") == F.col("s_suppkey"), "left")
    rows = rows.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    address = F.concat(F.col("s_name"), F.lit(", "), F.col("n_name"), F.lit(", "), F.col("r_name"))
    unit = F.when(F.col("p_type") == "STANDARD", "g").when(F.col("p_type") == "SMALL", "ml").when(F.col("p_type") == "MEDIUM", "kg").when(F.col("p_type") == "LARGE", "l").when(F.col("p_type") == "ECONOMY", "U").otherwise("cl")
    category = F.when(F.col("p_type").isin("STANDARD", "MEDIUM"), "weight").when(F.col("p_type").isin("SMALL", "LARGE"), "volume").otherwise("number")
    importer, importer_address = F.when(k % 7 == 0, F.concat(F.lit("Importer "), k.cast("string"))), F.when(k % 14 == 0, F.concat(F.lit("Dock "), k.cast("string"), F.lit(", Port Road")))
    country = F.when(k % 5 == 0, F.lit("India")).when((k % 5).isin(1, 2), F.col("n_name"))
    rows = rows.select(
        k.alias("package_id"), F.when(k % 3 == 0, "barcode_registry").otherwise("image").alias("analysis_source"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("commodity_name"), F.lit(0.0).alias("commodity_name_confidence"),
        null_if(F.col("s_name"), k % 4 == 0).alias("manufacturer_name"), F.when(k % 10 == 3, F.lit(None).cast("string")).when(k % 17 == 0, "Short").otherwise(address).alias("manufacturer_address"),
        F.when(k % 5 == 0, F.concat(F.lit("Packer "), k.cast("string"))).alias("packer_name"), F.when(k % 10 == 0, F.concat(F.lit("Plot "), k.cast("string"), F.lit(", Sector 9"))).alias("packer_address"),
        importer.alias("importer_name"), importer_address.alias("importer_address"), country.alias("country_of_origin"),
        null_if(F.col("p_size") * 10.0, k % 19 == 0).alias("net_quantity_value"), null_if(unit, k % 17 == 0).alias("net_quantity_unit"), null_if(category, k % 23 == 0).alias("net_quantity_category"),
        null_if(F.col("p_retailprice"), k % 23 == 0).alias("mrp_value"), F.when(k % 8 <= 1, True).when(k % 8 <= 3, False).alias("mrp_includes_tax"), (k % 29 == 0).alias("mrp_altered"),
        null_if(F.date_format("shipdate", "yyyy-MM-dd"), k % 11 == 0).alias("manufacture_date"), F.lit(None).cast("string").alias("expiry_date"), F.when(k % 33 == 0, "12 months").alias("best_before"),
        F.lit(None).cast("string").alias("consumer_care_name"), null_if(F.lit("1800 123 4567"), k % 13 == 0).alias("consumer_care_phone"), F.when(k % 26 == 0, "care@pack.example").alias("consumer_care_email"), F.lit(None).cast("string").alias("consumer_care_address"),
        F.when(k % 9 == 0, F.lpad(k.cast("string"), 14, "1")).alias("fssai_license_number"), (k % 18 == 1).alias("has_fssai_logo"), (k % 6 == 2).alias("has_veg_nonveg_symbol"), (k % 25 == 0).alias("has_isi_mark"), (k % 21 == 0).alias("has_recycling_symbol"),
        (k % 7 != 0).alias("has_english_text"), F.lit(False).alias("has_hindi_text"), (F.col("p_partkey") % 11 / 10.0).cast("double").alias("average_ocr_confidence"), (k % 20).cast("int").alias("total_text_blocks"),
        null_if((k % 7).cast("double"), k % 4 == 1).alias("mrp_contrast_ratio"), null_if((k % 9).cast("double"), k % 3 == 1).alias("net_qty_contrast_ratio"),
        null_if((k % 9) * 0.5, k % 10 == 0).cast("double").alias("mrp_font_height_mm"), null_if((k % 8) * 0.5, k % 10 == 0).cast("double").alias("net_qty_font_height_mm"), null_if((k % 5) * 0.5, k % 12 == 0).cast("double").alias("min_font_height_mm"),
        *[null_if(((k + i) % 6).cast("double"), k % 16 == 3).alias(f"net_qty_clear_space_{side}_mm") for i, side in enumerate(("above", "below", "left", "right"))],
        (F.col("p_size") * 1000.0 * F.when(k % 31 == 0, 100).otherwise(1)).cast("double").alias("principal_display_panel_area_mm2"), (k % 5 != 0).alias("declarations_on_principal_panel"),
        F.when(k % 37 == 0, "wholesale").otherwise("retail").alias("package_type"), F.lit(False).alias("is_multicomponent"), barcode_of(k).alias("barcode_value"), F.lit(None).cast("string").alias("barcode_type"),
        (k % 2 == 0).alias("product_identified"), F.when(k % 2 == 0, F.array(F.lit("open_food_facts"))).otherwise(F.array().cast("array<string>")).alias("product_data_sources"), F.col("p_brand").alias("barcode_registered_owner"), F.lit("INR").alias("mrp_currency"),
    )
    importers = (F.coalesce(F.col("importer_name"), F.lit("")) != "") | (F.coalesce(F.col("importer_address"), F.lit("")) != "")
    foreign = F.coalesce(F.col("country_of_origin"), F.lit("")).isin("", "India")
    facts = classified(rows.withColumn("is_imported", importers | ~foreign), "barcode_value")
    have = F.col("barcode_value").isNotNull()
    g = F.col("gtin")
    return facts.withColumns({
        "has_barcode": have, "barcode_gtin_format": F.when(have, g["format"]), "barcode_checksum_valid": F.when(have, g["checksum_valid"]), "barcode_country": F.when(have, g["country"]),
        "barcode_is_gs1_india": F.when(have, g["is_india"]), "barcode_is_restricted": F.when(have, g["is_restricted"]), "barcode_restricted_reason": F.when(have, g["restricted_reason"]), "barcode_valid": F.when(have, g["is_valid"]),
    }).drop("gtin")


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, text``: a label's text for each part, in several layouts."""
    k = key()
    part = table(spark, sf_dir, "part")
    shown = k.cast("string")
    quantity = F.when(k % 6 == 0, F.concat(F.lit("Net Wt "), F.col("p_size").cast("string"), F.lit(" g"))).when(k % 6 == 1, F.concat(F.lit("3x"), F.col("p_size").cast("string"), F.lit(" Tablets"))).when(k % 6 == 2, F.concat(F.lit("NET QTY: "), F.col("p_size").cast("string"), F.lit(".5 ml"))).when(k % 6 == 3, F.concat(F.col("p_size").cast("string"), F.lit("Og"))).when(k % 6 == 4, F.concat(F.col("p_size").cast("string"), F.lit(" capsules"))).otherwise("")
    price = F.when(k % 4 == 0, F.concat(F.lit("MRP Rs "), F.format_string("%.2f", F.col("p_retailprice")), F.lit(" incl. of all taxes"))).when(k % 4 == 1, F.concat(F.lit("M.R.P ₹"), F.format_string("%.2f", F.col("p_retailprice")))).when(k % 4 == 2, F.concat(F.lit("Price "), F.format_string("%.2f", F.col("p_retailprice")))).otherwise("")
    dates = F.when(k % 5 == 0, "PKD 05/2024\nBest Before 12 months").when(k % 5 == 1, "MFD: 02-MAR-2025 EXP: 01-SEP-2026").when(k % 5 == 2, "05/26 and 10/27").when(k % 5 == 3, "02-MAR-2025").otherwise("")
    maker = F.when(k % 3 == 0, F.concat(F.lit("Mfd by: Maker "), shown, F.lit("\n12 Mill Road\nPune 411001\nNet"))).when(k % 3 == 1, F.concat(F.lit("Packed by Packer "), shown, F.lit("\nMktd by Seller "), shown, F.lit(", Agra"))).otherwise(F.concat(F.lit("Imported by Trader "), shown, F.lit("\nDock 4\nMRP")))
    care = F.when(k % 7 == 0, "Customer Care: 1800 123 4567 help@pack.example").when(k % 7 == 1, "call 9876543210").when(k % 7 == 2, "मूल्य FSSAI Lic No. 12345678901234").when(k % 7 == 3, "FSSAI xx 10012345678901 end").otherwise("info@shop.example")
    return part.select(k.alias("image_id"), F.concat_ws("\n", F.col("p_name"), quantity, price, dates, maker, care).alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, block_no, text, confidence, bbox``: each line of a document as a reader's block."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    left, top, wide = (F.col("image_id") % 7).cast("double"), F.col("block_no") * 20.0, F.length("text") * 6.0
    tall = 10.0 + F.pmod(F.col("image_id") + F.col("block_no") * 3, F.lit(9))
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((left, top), (left + wide, top + 1), (left + wide, top + tall), (left, top + tall + 2))])
    return rows.select("image_id", F.col("block_no").cast("int").alias("block_no"), "text", (F.pmod(F.col("image_id") + F.col("block_no"), F.lit(10)) / 10.0).cast("double").alias("confidence"), corners.alias("bbox"))


def image_sizes(blocks: DataFrame) -> DataFrame:
    """``image_id, width, height`` of images that hold blocks with rectangles; unknown for every seventh."""
    sizes = blocks.groupBy("image_id").agg(F.max("rect.x2").alias("width"), F.max("rect.y2").alias("height"))
    return sizes.where("image_id % 7 > 0")


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of a document: page, block, paragraph and line numbers, and its ``words`` as an array of structs."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    image, line = F.col("image_id"), F.col("line")

    def word(text: Column, w: Column) -> Column:
        return F.struct(
            w.cast("int").alias("word_no"), text.alias("text"), (w * 50.0).cast("double").alias("left"), (line * 20.0 + w % 3).cast("double").alias("top"), (F.length(text) * 6.0).cast("double").alias("width"),
            (10.0 + w % 4).cast("double").alias("height"), F.pmod(image * 7 + w * 13 + line, F.lit(101)).cast("double").alias("conf"))

    return rows.select(
        "image_id", (image % 3).cast("int").alias("page_num"), (line / 4).cast("int").alias("block_num"), (line % 2).cast("int").alias("par_num"), line.cast("int").alias("line_num"), F.transform(F.split("content", " "), word).alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents' lines with page, block, paragraph and line numbers."""
    return word_lists(spark, sf_dir).selectExpr("* EXCEPT (words)", "inline(words)")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, box_no, x1, y1, x2, y2, confidence``: an order's lines as overlapping boxes."""
    item = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 10.0
    rows = item.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_no"), x.alias("x1"), y.cast("double").alias("y1"), (x + 20).alias("x2"), (y + 8 + F.col("l_linenumber") % 3 * 6).cast("double").alias("y2"), (1 - F.col("l_discount")).alias("confidence"), "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy("image_id", "box_no").agg(*[F.min_by(c, F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on the same boxes, in seven classes from two detectors."""
    names = F.array(*map(F.lit, ("fssai_logo", "veg_symbol", "nonveg_symbol", "isi_mark", "recycling_symbol", "barcode", "qr_code")))
    rows = boxes(spark, sf_dir)
    kind = F.get(names, (F.pmod(F.col("image_id") + (F.col("box_no") / 3).cast("int"), F.lit(7))).cast("int"))
    return rows.select("image_id", F.col("box_no").alias("symbol_no"), kind.alias("class_name"), F.round(F.col("confidence") - 0.4, 2).alias("confidence"), "x1", "y1", "x2", "y2", F.when(F.col("box_no") % 2 == 0, "yolo").otherwise("heuristic").alias("source"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("image_id"), F.col("vec_id").alias("point_no"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def registry_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gtin, source, payload``: JSON answers of three registries about the parts' codes, with gaps."""
    k = key()
    part = table(spark, sf_dir, "part").withColumn("gtin", F.lpad(k.cast("string"), 13, "0"))
    size = F.col("p_size").cast("string")
    tags = F.when(k % 3 == 0, F.array(F.lit("en:vegetarian"), F.lit("en:organic"))).when(k % 3 == 1, F.array(F.lit("en:non-vegetarian"))).otherwise(F.array(F.lit("en:non-vegan")))
    product = F.struct(
        F.when(k % 4 != 0, F.col("p_name")).alias("product_name"), F.concat(F.col("p_brand"), F.lit(", Other")).alias("brands"), F.when(k % 5 == 0, F.lit("6 x 30 g")).when(k % 5 == 1, F.lit("1,5 L")).when(k % 5 == 2, F.concat(size, F.lit(" pcs"))).when(k % 5 == 3, F.lit("a box")).alias("quantity"),
        F.when(k % 2 == 0, F.array(F.lit("en:south-africa"), F.lit("en:india"))).alias("origins_tags"), tags.alias("labels_tags"), F.lit(" Snacks, , Salty ,Crisps").alias("categories"), F.when(k % 9 == 0, F.concat(F.lit("Rs. "), size, F.lit(".50"))).alias("stores"), F.lit(" ,salt, oil, ").alias("ingredients_text"), F.lit("http://i.example/a.png").alias("image_url"))
    facts = part.where(k % 7 != 0).select("gtin", F.lit("open_food_facts").alias("source"), F.to_json(F.struct(F.when(k % 10 == 9, "failure").otherwise("1").alias("status"), product.alias("product"))).alias("payload"))
    item = F.struct(F.upper(F.col("p_name")).alias("title"), F.when(k % 3 == 0, F.col("p_brand")).alias("brand"), F.concat(size, F.lit(" oz")).alias("size"), F.lit("Food > Snacks >  > Crisps").alias("category"), F.array(F.lit("http://i.example/b.png"), F.lit("http://i.example/a.png")).alias("images"))
    upc = part.where(k % 3 != 1).select("gtin", F.lit("upcitemdb").alias("source"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    own = F.struct(F.when(k % 2 == 0, F.col("p_name")).alias("productName"), F.lit("Maker Ltd,").alias("companyName"), F.concat(size, F.lit(" kg")).alias("netContent"), F.when(k % 4 == 0, F.format_string("%.1f", F.col("p_retailprice"))).alias("mrp"), F.when(k % 6 == 0, "Veg").when(k % 6 == 1, "Non-Veg").alias("vegNonVeg"), F.lit("1800 1").alias("customerCareNumber"))
    national = part.where(k % 5 == 0).select("gtin", F.lit("gs1_india_datakart").alias("source"), F.to_json(F.struct(own.alias("product"))).alias("payload"))
    return facts.unionByName(upc).unionByName(national)


def knowledge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gtin, source, payload``: answers of a knowledge base about the parts' codes; labels differ, some have no binding, some are cut off."""
    k = key()
    part = table(spark, sf_dir, "part").where(k % 4 != 1)
    value = lambda x: F.struct(F.lit("literal").alias("type"), x.alias("value"))
    binding = F.struct(
        value(F.concat(F.col("p_name"), F.lit(" ,"))).alias("itemLabel"), F.when(k % 3 == 0, value(F.col("p_brand"))).alias("brandLabel"), F.when(k % 5 < 3, value(F.lit("Maker"))).alias("manufacturerLabel"),
        F.when(k % 2 == 0, value(F.lit("India"))).alias("countryLabel"), F.when(k % 6 == 0, value(F.col("p_type"))).alias("boxLabel"))
    body = F.when(k % 7 == 0, F.lit('{"results": {"bindings": []}}')).otherwise(F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results"))))
    cut = F.when(k % 11 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).when(k % 13 == 0, F.lit(" ")).when(k % 17 == 0, F.lit(None).cast("string")).otherwise(body)
    return part.select(F.lpad(k.cast("string"), 13, "0").alias("gtin"), F.lit("wikidata").alias("source"), cut.alias("payload"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, model_no, status, body``: what up to three models say about each part; some fail, some add fences, some say no JSON."""
    k = key()
    part = table(spark, sf_dir, "part").select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("model_no"))
    turn = F.pmod(k + F.col("model_no") * 3, F.lit(7))
    rule = lambda i: F.struct(F.when((k + i) % 4 > 0, F.concat(F.lit(f"L{i}-"), F.col("model_no").cast("string"))).alias("rule_id"), F.when((k + i) % 3 > 0, "pass").alias("status"), F.when((k + i) % 5 > 2, "major").alias("severity"))
    said = F.to_json(F.struct(F.col("p_name").alias("product_name"), (F.col("p_size") / 50.0).alias("compliance_score"), F.array(rule(0), rule(1)).alias("rules")))
    shown = F.when(turn == 0, F.lit("I can't say.")).when(turn == 1, "").when(turn == 2, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(turn == 3, F.concat(F.lit("``` "), said, F.lit("```"))).when(turn == 4, F.concat(said, F.lit(" as asked"))).otherwise(said)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(shown.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    status = F.when(turn == 5, 503).otherwise(200)
    return part.where("NOT (p_partkey % 9 = 0 AND model_no > 0)").select(k.alias("request_id"), "model_no", status.alias("status"), F.when(status == 200, body).alias("body"))


def error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, declared, actual, category`` of weighed packages."""
    k = key()
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("weight", "Volume ", "length", "area", "number", "other")))
    joined = item.join(part, item["l_partkey"] == part["p_partkey"])
    declared = F.col("p_size") * F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 10.0).when(k % 4 == 2, 100.0).otherwise(500.0)
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", declared.alias("declared"), (declared - F.col("l_quantity")).alias("actual"), F.get(kinds, (k % 6).cast("int")).alias("category"))
