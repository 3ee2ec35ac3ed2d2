"""Registry payloads: JSON adapters, merging by trust with provenance, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

FACTS = (
    "status string, product struct<product_name:string, product_name_en:string, generic_name:string, brands:string, manufacturer:string, manufacturing_places:string, "
    "emb_codes:string, quantity:string, origin:string, origins_tags:array<string>, manufacturing_places_tags:array<string>, labels_tags:array<string>, "
    "ingredients_analysis_tags:array<string>, categories:string, ingredients_text:string, customer_service:string, image_front_url:string, image_url:string, stores:string, labels:string>"
)
FACTS_OK = ("1", "success", "success_with_warnings")
UPC = "items array<struct<title:string, brand:string, manufacturer:string, size:string, weight:string, dimension:string, category:string, images:array<string>>>"


def trust_rank(source: Column) -> Column:
    """0 for the most trusted registry; unknown ones come last."""
    return F.coalesce(text.lookup({s: i for i, s in enumerate(fixed.TRUST)}, source), F.lit(fixed.UNKNOWN_TRUST))


def _quantity(raw: Column) -> list[Column]:
    q = text.registry_quantity(raw)
    return [q["raw"].alias("net_quantity_raw"), q["value"].alias("net_quantity_value"), q["unit"].alias("net_quantity_unit")]


def facts_records(payloads: DataFrame) -> DataFrame:
    """Records of the open product databases from ``payloads(gtin, source, payload)``; payloads without a product go."""
    p = F.col("_j.product")
    rows = payloads.withColumn("_j", F.from_json("payload", FACTS)).where(F.col("_j.status").isin(*FACTS_OK) & F.col("_j.product").isNotNull())
    brand = F.get(F.split(p["brands"], ","), F.lit(0))
    origin = text.first_truthy(p["origin"], text.pretty_tags(p["origins_tags"]), text.pretty_tags(p["manufacturing_places_tags"]))
    none = F.array().cast("array<string>")
    tags = F.concat(F.coalesce(p["labels_tags"], none), F.coalesce(p["ingredients_analysis_tags"], none))
    return rows.select(
        "gtin", "source", text.clean(text.first_truthy(p["product_name"], p["product_name_en"], p["generic_name"])).alias("product_name"), text.clean(brand).alias("brand"),
        text.clean(text.first_truthy(p["manufacturer"], brand)).alias("manufacturer_name"), text.clean(text.first_truthy(p["manufacturing_places"], p["emb_codes"])).alias("manufacturer_address"),
        text.clean(origin).alias("country_of_origin"), *_quantity(p["quantity"]), text.registry_price(p["stores"], p["labels"]).alias("mrp_value"), text.diet(tags).alias("veg_non_veg"),
        text.clean(p["customer_service"]).alias("consumer_care"), text.clean(p["ingredients_text"]).alias("ingredients"), F.coalesce(text.categories(p["categories"], ","), none).alias("categories"),
        F.filter(F.array(p["image_front_url"], p["image_url"]), lambda x: x != "").alias("image_urls"),
    )


def upc_records(payloads: DataFrame) -> DataFrame:
    """Records of the UPC database: the first item of each payload."""
    it = F.get(F.col("_j.items"), F.lit(0))
    rows = payloads.withColumn("_j", F.from_json("payload", UPC)).where(F.size("_j.items") > 0)
    none = F.array().cast("array<string>")
    return rows.select("gtin", "source", text.clean(it["title"]).alias("product_name"), text.clean(it["brand"]).alias("brand"), text.clean(text.first_truthy(it["manufacturer"], it["brand"])).alias("manufacturer_name"),
                       *_quantity(text.first_truthy(it["size"], it["weight"], it["dimension"])), F.coalesce(text.categories(it["category"], ">"), none).alias("categories"), F.coalesce(it["images"], none).alias("image_urls"))


def national_records(payloads: DataFrame) -> DataFrame:
    """Records of the national registry, whose product lies under one of several keys and whose fields have aliases."""
    nested = text.first_truthy(*[F.get_json_object("payload", f"$.{k}") for k in ("product", "products[0]", "data")], F.col("payload"))
    rows = payloads.withColumn("_p", nested)

    def field(*names: str) -> Column:
        return text.clean(text.first_truthy(*[F.get_json_object("_p", f"$.{n}") for n in names]))

    price = F.coalesce(text.registry_price(field("mrp"), field("MRP")), F.when(field("mrp").rlike(r"^\d+\.?\d*$"), field("mrp").try_cast("double")))
    diet = F.lower(field("vegNonVeg"))
    return rows.select(
        "gtin", "source", field("productName", "product_name", "productDescription").alias("product_name"), field("brandName", "brand_name", "brand").alias("brand"),
        field("manufacturedBy", "manufacturer", "companyName", "company_name", "brandOwner").alias("manufacturer_name"),
        field("manufacturedByAddress", "companyAddress", "company_address", "manufacturerAddress").alias("manufacturer_address"),
        field("packedBy", "marketedBy").alias("packer_name"), field("packedByAddress").alias("packer_address"), field("importedBy").alias("importer_name"), field("importedByAddress").alias("importer_address"),
        F.coalesce(field("countryOfOrigin", "country_of_origin"), F.lit("India")).alias("country_of_origin"), *_quantity(field("netContent", "net_content", "netQuantity", "quantity")),
        price.alias("mrp_value"), F.lit("INR").alias("mrp_currency"), field("manufacturingDate", "packagingDate").alias("manufacture_date"), field("bestBefore").alias("best_before"),
        field("fssaiLicenseNo", "fssai").alias("fssai_license"), F.when(diet.startswith("veg"), "VEG").when(diet.contains("non"), "NON_VEG").alias("veg_non_veg"),
        field("customerCareDetails", "consumerCare").alias("consumer_care"), field("customerCareNumber", "consumerCarePhone").alias("consumer_care_phone"), field("customerCareEmail", "consumerCareEmail").alias("consumer_care_email"),
    )


def parsed(payloads: DataFrame) -> DataFrame:
    """``payloads(gtin, source, payload)`` with the variant ``j``, null where the payload isn't JSON."""
    return payloads.withColumn("j", text.json_value(F.col("payload")))


def malformed(payloads: DataFrame) -> DataFrame:
    """What has to be set aside: payloads that are no JSON, with the reason. A missing payload is no answer, not a malformed one."""
    held = parsed(payloads.where("payload IS NOT NULL"))
    return held.where("j IS NULL").select("gtin", "source", "payload", F.when(F.trim("payload") == "", "empty").otherwise("no JSON").alias("reason"))


def knowledge_records(payloads: DataFrame) -> DataFrame:
    """Records of the knowledge base: the first binding of each answer, whose labels differ by answer; answers without one go."""
    held = parsed(payloads).withColumn("b", F.try_variant_get("j", "$.results.bindings[0]", "variant")).where("b IS NOT NULL")

    def label(name: str) -> Column:
        return text.clean(F.try_variant_get("b", f"$.{name}.value", "string"))

    return held.select("gtin", "source", label("itemLabel").alias("product_name"), label("brandLabel").alias("brand"), label("manufacturerLabel").alias("manufacturer_name"), label("countryLabel").alias("country_of_origin"))


def knowledge_labels(payloads: DataFrame) -> DataFrame:
    """``gtin, label, value``: all labels of the first binding of each answer, whatever they are."""
    held = parsed(payloads).select("gtin", F.try_variant_get("j", "$.results.bindings[0]", "variant").alias("b"))
    rows = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("b").outer()))
    return rows.select("gtin", F.col("key").alias("label"), text.clean(F.try_variant_get("value", "$.value", "string")).alias("value")).where("value IS NOT NULL")


def code_variants(codes: DataFrame) -> DataFrame:
    """The spellings under which a knowledge base may hold a code: as is, without leading zeros, padded to 13 and 14 digits."""
    g = F.col("gtin")
    variants = F.array_distinct(F.array(g, F.regexp_replace(g, "^0+", ""), F.when(F.length(g) < 13, F.lpad(g, 13, "0")).otherwise(g), F.when(F.length(g) < 14, F.lpad(g, 14, "0")).otherwise(g)))
    return codes.select("*", F.explode(variants).alias("variant"))


def merged_records(records: DataFrame) -> DataFrame:
    """One record per gtin: each field from the most trusted registry that has it, with the field's source.

    Empty strings and lists count as missing, zero doesn't. All fields are one
    aggregation by gtin, combined before the shuffle. A quantity that only came as
    text is read from it.
    """
    have = set(records.columns)
    rank = F.struct(trust_rank(F.col("source")).alias("rank"), F.col("source"))
    aggs, fields = [], [f for f in fixed.MERGED_FIELDS if f in have]
    for f in fields:
        filled = F.col(f).isNotNull() if f in fixed.NUMBER_FIELDS else (F.col(f) != "")
        aggs += [F.min_by(F.when(filled, F.col(f)), F.when(filled, rank)).alias(f), F.min(F.when(filled, rank))["source"].alias(f"_from_{f}")]
    lists = [c for c in ("categories", "image_urls") if c in have]
    for c in lists:
        aggs.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"]))).alias(c))
    aggs.append(F.transform(F.array_sort(F.collect_list(rank)), lambda s: s["source"]).alias("sources"))
    merged = records.groupBy("gtin").agg(*aggs)
    if "net_quantity_raw" in have:
        derived = text.registry_quantity(F.col("net_quantity_raw"))
        need = F.col("net_quantity_value").isNull() & derived["value"].isNotNull()
        merged = merged.withColumns({
            "_from_net_quantity_value": F.when(need, F.col("_from_net_quantity_raw")).otherwise(F.col("_from_net_quantity_value")),
            "net_quantity_unit": F.when(F.col("net_quantity_value").isNull(), F.coalesce(derived["unit"], "net_quantity_unit")).otherwise(F.col("net_quantity_unit")),
            "net_quantity_value": F.coalesce("net_quantity_value", derived["value"]),
        })
    named = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f"_from_{f}") for f in fields])), lambda _, v: v.isNotNull())
    found = F.size("sources") > 0
    identity = [text.truthy(F.col(f)) for f in ("product_name", "brand", "net_quantity_raw", "manufacturer_name") if f in have]
    known = identity[0]
    for x in identity[1:]:
        known = known | x
    return merged.withColumn("field_sources", named).withColumn("found", found & known).drop(*[f"_from_{f}" for f in fields])


def fill_gaps(records: DataFrame, readings: DataFrame) -> DataFrame:
    """Blank fields of ``records`` filled from ``readings(gtin, package fields)``; what is filled is noted, and the source added once."""
    fields = {r: p for r, p in fixed.GAP_FIELDS.items() if r in records.columns and p in readings.columns}
    renamed = readings.select(F.col("gtin").alias("_gtin"), *[F.col(p).alias(f"_r_{r}") for r, p in fields.items()])
    joined = records.join(renamed, F.col("gtin") == F.col("_gtin"), "left")
    new, filled = {}, []
    for r in fields:
        number = r in fixed.NUMBER_FIELDS
        blank = F.col(r).isNull() if number else ~text.truthy(F.col(r))
        has = F.col(f"_r_{r}").isNotNull() if number else text.truthy(F.col(f"_r_{r}"))
        new[r] = F.when(blank & has, F.col(f"_r_{r}")).otherwise(F.col(r))
        filled.append(F.when(blank & has, F.lit(r)))
    names = F.filter(F.array(*filled), lambda x: x.isNotNull())
    joined = joined.withColumn("_filled", names).withColumns(new)
    added = F.map_from_arrays(F.col("_filled"), F.transform("_filled", lambda _: F.lit(fixed.GAP_SOURCE)))
    old = F.map_filter("field_sources", lambda k, _: ~F.array_contains(F.col("_filled"), k))
    sources = F.when((F.size("_filled") > 0) & ~F.array_contains("sources", fixed.GAP_SOURCE), F.array_append("sources", F.lit(fixed.GAP_SOURCE))).otherwise(F.col("sources"))
    return joined.withColumn("field_sources", F.map_concat(old, added)).withColumn("sources", sources).drop("_gtin", "_filled", *[f"_r_{r}" for r in fields])
