"""Package records: from declarations, from registries, merged from two sides; features and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip, truthy

TEXT_FIELDS = [
    "commodity_name", "manufacturer_name", "manufacturer_address", "packer_name", "packer_address", "importer_name", "importer_address",
    "consumer_care_name", "consumer_care_phone", "consumer_care_email", "consumer_care_address", "fssai_license_number", "manufacture_date",
    "expiry_date", "best_before", "net_quantity_unit", "barcode_value", "barcode_type", "barcode_country", "net_quantity_category",
]
NUMBERS = [
    "net_quantity_value", "mrp_value", "mrp_font_height_mm", "net_qty_font_height_mm", "min_font_height_mm", "mrp_contrast_ratio", "net_qty_contrast_ratio",
    "net_qty_clear_space_above_mm", "net_qty_clear_space_below_mm", "net_qty_clear_space_left_mm", "net_qty_clear_space_right_mm",
    "principal_display_panel_area_mm2", "commodity_name_confidence",
]
FLAGS = [
    "has_fssai_logo", "has_veg_nonveg_symbol", "has_isi_mark", "has_recycling_symbol", "has_barcode", "has_hindi_text", "has_english_text",
    "declarations_on_principal_panel", "is_imported", "is_multicomponent", "mrp_includes_tax", "mrp_altered",
]
#: Fields that a merge of two sides sets back to their defaults.
RESET = {
    "country_of_origin": "string", "mrp_currency": "string", "barcode_gtin_format": "string", "barcode_checksum_valid": "boolean",
    "barcode_is_gs1_india": "boolean", "barcode_is_restricted": "boolean", "barcode_registered_owner": "string",
}


def unit_and_category(raw: Column) -> Column:
    """``unit, category``: the canonical unit; an unknown one stays as it is and counts as a number."""
    key = F.replace(strip(F.lower(raw)), F.lit("."), F.lit(""))
    table = {u: (v, category) for category, units in fixed.PACKAGE_UNITS.items() for u, v in units.items()}
    entries = [x for u, (v, category) in table.items() for x in (F.lit(u), F.struct(F.lit(v).alias("unit"), F.lit(category).alias("category")))]
    known = F.element_at(F.create_map(*entries), key)
    return F.when(raw.isNotNull(), F.coalesce(known, F.struct(raw.alias("unit"), F.lit("number").alias("category"))))


def imported(importer_name: Column, importer_address: Column, country: Column | None = None) -> Column:
    """An importer makes a package imported; in registries also a country other than India."""
    by_importer = truthy(importer_name) | truthy(importer_address)
    if country is None:
        return by_importer
    return by_importer | (truthy(country) & ~F.coalesce(F.lower(strip(country)), F.lit("")).isin("india", ""))


def packages_from_labels(labels: DataFrame) -> DataFrame:
    """Package fields from ``labels(image_id, declarations, ...)`` with the struct that ``functions.text.declarations`` makes."""
    d = F.col("declarations")
    unit = unit_and_category(d["quantity"]["unit"])
    party = d["parties"]
    importer, address = party["importer"]["name"], party["importer"]["address"]
    return labels.select(
        "*", d["mrp"]["value"].alias("mrp_value"), F.when(d["mrp"]["value"].isNotNull(), F.coalesce(F.lower(d["mrp"]["raw"]).rlike("incl|all tax"), F.lit(False))).alias("mrp_includes_tax"),
        d["quantity"]["value"].alias("net_quantity_value"), unit["unit"].alias("net_quantity_unit"), unit["category"].alias("net_quantity_category"),
        d["fssai_license"].alias("fssai_license_number"), d["dates"]["made"].alias("manufacture_date"), d["dates"]["expires"].alias("expiry_date"), d["dates"]["best_before"].alias("best_before"),
        party["manufacturer"]["name"].alias("manufacturer_name"), party["manufacturer"]["address"].alias("manufacturer_address"), party["packer"]["name"].alias("packer_name"), party["packer"]["address"].alias("packer_address"),
        importer.alias("importer_name"), address.alias("importer_address"), d["care"]["phone"].alias("consumer_care_phone"), d["care"]["email"].alias("consumer_care_email"),
        d["scripts"]["hindi"].alias("has_hindi_text"), d["scripts"]["english"].alias("has_english_text"), imported(importer, address).alias("is_imported"),
    )


def packages_from_records(records: DataFrame) -> DataFrame:
    """Package fields from merged registry records with a ``gtin`` struct of facts about the code in ``code_facts``."""
    unit = unit_and_category(F.nullif(F.col("net_quantity_unit"), F.lit("")))
    facts = F.col("code_facts")
    return records.select(
        "gtin", F.lit("barcode_registry").alias("analysis_source"), F.col("product_name").alias("commodity_name"), "manufacturer_name", "net_quantity_value",
        unit["unit"].alias("net_quantity_unit"), unit["category"].alias("net_quantity_category"), "mrp_value", F.lit(None).cast("boolean").alias("mrp_includes_tax"), "country_of_origin",
        imported(F.col("importer_name"), F.col("importer_address"), F.col("country_of_origin")).alias("is_imported"), F.coalesce(F.col("veg_non_veg").isin("VEG", "NON_VEG"), F.lit(False)).alias("has_veg_nonveg_symbol"),
        F.lit(True).alias("has_barcode"), F.col("gtin").alias("barcode_value"), facts["format"].alias("barcode_gtin_format"), facts["checksum_valid"].alias("barcode_checksum_valid"), facts["is_valid"].alias("barcode_valid"),
        facts["country"].alias("barcode_country"), facts["is_india"].alias("barcode_is_gs1_india"), facts["is_restricted"].alias("barcode_is_restricted"),
        F.coalesce(F.nullif("brand", F.lit("")), "manufacturer_name").alias("barcode_registered_owner"), F.col("sources").alias("product_data_sources"), F.col("field_sources").alias("data_provenance"), F.col("found").alias("product_identified"),
    )


def merged_sides(primary: DataFrame, secondary: DataFrame, key: str = "package_id") -> DataFrame:
    """Front and back of a package in one record.

    Texts: the front's unless null (an empty one wins). Numbers: likewise, NaN
    counting as null. Flags: either side's, null counting as false. Confidence:
    weighted by blocks. Fields in RESET are null again.
    """
    p, s = primary.alias("p"), secondary.alias("s")
    have = set(primary.columns)

    def number(side: str, f: str) -> Column:
        value = F.col(f"{side}.{f}")
        return F.when(~F.isnan(value), value)

    blocks_p, blocks_s = F.coalesce("p.total_text_blocks", F.lit(0)), F.coalesce("s.total_text_blocks", F.lit(0))
    total = blocks_p + blocks_s
    weighted = F.coalesce("p.average_ocr_confidence", F.lit(0.0)) * blocks_p + F.coalesce("s.average_ocr_confidence", F.lit(0.0)) * blocks_s
    return p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "left").select(
        F.col(f"p.{key}").alias(key), *[F.coalesce(f"p.{f}", f"s.{f}").alias(f) for f in TEXT_FIELDS if f in have], *[F.coalesce(number("p", f), number("s", f)).alias(f) for f in NUMBERS if f in have],
        *[(F.coalesce(f"p.{f}", F.lit(False)) | F.coalesce(f"s.{f}", F.lit(False))).alias(f) for f in FLAGS if f in have], F.col("p.package_type").alias("package_type"),
        F.when(total > 0, weighted / total).otherwise(F.lit(0.0)).alias("average_ocr_confidence"), total.cast("int").alias("total_text_blocks"),
        F.lit("image").alias("analysis_source"), *[F.lit(None).cast(t).alias(f) for f, t in RESET.items() if f in have],
    )


def first_codes(scans: DataFrame) -> DataFrame:
    """The distinct codes of each image by first sight, and which is the image's first."""
    image = Window.partitionBy("image_id").orderBy("scan_no")
    once = scans.groupBy("image_id", "code").agg(F.min("scan_no").alias("scan_no"))
    return once.withColumn("is_first", F.row_number().over(image) == 1)


def attach_codes(packages: DataFrame, codes: DataFrame) -> DataFrame:
    """Packages with the first code of their image."""
    first = codes.where("is_first").select(F.col("image_id").alias("package_id"), F.col("code").alias("barcode_value"))
    joined = packages.drop("barcode_value", "has_barcode").join(first, "package_id", "left")
    return joined.withColumn("has_barcode", F.col("barcode_value").isNotNull())


def features(packages: DataFrame, key: str = "package_id", more: list[str] | None = None) -> DataFrame:
    """The model's columns in order: presence bits, measures (null where unknown), and the imported bit; then columns ``more`` as they are."""
    def bit(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    c = F.col
    space = F.least(*[c(f"net_qty_clear_space_{side}_mm") for side in ("above", "below", "left", "right")])
    height = c("net_qty_font_height_mm")
    declared = ["commodity_name", "manufacturer_name", "manufacturer_address", "packer_name", "packer_address", "importer_name", "importer_address", "net_quantity_value", "mrp_value", "manufacture_date", "expiry_date", "best_before", "consumer_care_name", "consumer_care_phone", "consumer_care_email"]
    values = {
        "has_commodity_name": bit(truthy(c("commodity_name"))), "has_manufacturer_name": bit(truthy(c("manufacturer_name"))), "has_manufacturer_address": bit(truthy(c("manufacturer_address"))),
        "has_packer_info": bit(truthy(c("packer_name")) | truthy(c("packer_address"))), "has_net_quantity": bit(c("net_quantity_value").isNotNull()), "has_mrp": bit(c("mrp_value").isNotNull()),
        "has_mfg_date": bit(truthy(c("manufacture_date"))), "has_expiry_date": bit(truthy(c("expiry_date")) | truthy(c("best_before"))),
        "has_consumer_care_phone": bit(truthy(c("consumer_care_phone"))), "has_consumer_care_email": bit(truthy(c("consumer_care_email"))),
        "has_fssai": bit(c("has_fssai_logo") | truthy(c("fssai_license_number"))), "has_veg_nonveg_symbol": bit(c("has_veg_nonveg_symbol")), "has_barcode": bit(c("has_barcode")),
        "has_hindi": bit(c("has_hindi_text")), "has_english": bit(c("has_english_text")), "on_principal_panel": bit(c("declarations_on_principal_panel")),
        "mrp_font_height_mm": c("mrp_font_height_mm"), "net_qty_font_height_mm": height, "min_font_height_mm": c("min_font_height_mm"), "mrp_contrast_ratio": c("mrp_contrast_ratio"),
        "qty_clear_space_ratio": F.when(height != 0, space / height), "panel_area_mm2": c("principal_display_panel_area_mm2"), "net_quantity_value": c("net_quantity_value"), "mrp_value": c("mrp_value"),
        "avg_ocr_confidence": c("average_ocr_confidence"), "num_declarations_found": reduce(lambda a, b: a + b, [c(f).isNotNull().cast("int") for f in declared]), "is_imported": bit(c("is_imported")),
    }
    return packages.select(key, *[values[f].alias(f) for f in fixed.FEATURES], *(more or []))


def feature_types() -> dict[str, str]:
    """Whether each feature is nominal or continuous, by its name, in the order of the columns."""
    return {f: "nominal" if f.startswith("has_") or f in ("on_principal_panel", "is_imported") else "continuous" for f in fixed.FEATURES}


def weak_label(results: Column) -> Column:
    """0 if a critical rule fails, else 1."""
    return F.when(F.exists(results, lambda r: (r["status"] == "FAIL") & (r["severity"] == "CRITICAL")), 0).otherwise(1)


def synthetic_label(rows: DataFrame) -> Column:
    """Whether a synthetic feature row is compliant: six required bits, a contact, a language, both letter heights known and at least 1 mm."""
    c = F.col
    required = reduce(lambda a, b: a & b, [c(f) == 1 for f in ("has_commodity_name", "has_manufacturer_name", "has_manufacturer_address", "has_net_quantity", "has_mrp", "has_mfg_date")])
    contact = (c("has_consumer_care_phone") == 1) | (c("has_consumer_care_email") == 1)
    language = (c("has_hindi") == 1) | (c("has_english") == 1)
    heights = F.coalesce((c("mrp_font_height_mm") >= 1.0) & (c("net_qty_font_height_mm") >= 1.0), F.lit(False))
    return (required & contact & language & heights).cast("int")


def packages_from_readings(readings: DataFrame, key: str = "package_id") -> DataFrame:
    """Package fields from a language model's answer in the struct ``j``: its dates stand in for the manufacture date, its care text for the e-mail."""
    d = F.col("j.declarations")
    code = F.nullif(d["barcode_printed"], F.lit(""))
    return readings.select(
        key, F.coalesce(F.nullif("j.product_name", F.lit("")), F.lit(None).cast("string")).alias("commodity_name"), d["mrp_value"].alias("mrp_value"), d["net_quantity_value"].alias("net_quantity_value"), d["net_quantity_unit"].alias("net_quantity_unit"),
        F.coalesce(F.nullif(d["manufacture_date"], F.lit("")), d["dates"]).alias("manufacture_date"), F.coalesce(F.nullif(d["consumer_care_email"], F.lit("")), d["consumer_care"]).alias("consumer_care_email"),
        code.isNotNull().alias("has_barcode"), code.alias("barcode_value"), F.when(code.isNotNull(), F.when(F.length(code) == 13, "EAN-13").otherwise("BARCODE")).alias("barcode_type"),
    )


def apply_declarations(declared: DataFrame, key: str = "package_id") -> DataFrame:
    """Rows ``field, value, raw`` of loose declarations applied to package fields: quantities split into number and unit, prices stripped to digits."""
    value, number_of_price = F.col("value"), F.regexp_replace(F.col("value"), r"[^\d.]", "").try_cast("double")
    amount, unit = F.regexp_extract(value, r"^([\d.]+)\s*([a-zA-Z]+)", 1).try_cast("double"), F.nullif(F.regexp_extract(value, r"^([\d.]+)\s*([a-zA-Z]+)", 2), F.lit(""))
    canonical = unit_and_category(unit)

    def of(field: str, x: Column) -> Column:
        return F.max_by(F.when(F.col("field") == field, x), F.when((F.col("field") == field) & x.isNotNull(), F.col("seq")))

    tax = F.coalesce(F.lower("raw").rlike("incl|all tax"), F.lit(False))
    return declared.groupBy(key).agg(
        of("commodity_name", value).alias("commodity_name"), of("net_quantity", amount).alias("net_quantity_value"), of("net_quantity", canonical["unit"]).alias("net_quantity_unit"), of("net_quantity", canonical["category"]).alias("net_quantity_category"),
        of("mrp", number_of_price).alias("mrp_value"), of("mrp", tax).alias("mrp_includes_tax"))


def attach_registry(packages: DataFrame, records: DataFrame) -> DataFrame:
    """Label packages with the registry's record of their code: six fields are filled where empty, and noted as such."""
    fields = {"commodity_name": "product_name", "manufacturer_name": "manufacturer_name", "manufacturer_address": "manufacturer_address", "country_of_origin": "country_of_origin", "net_quantity_value": "net_quantity_value", "net_quantity_unit": "net_quantity_unit"}
    renamed = records.select(F.col("gtin").alias("_gtin"), *[F.col(r).alias(f"_r_{p}") for p, r in fields.items()], F.col("sources").alias("_sources"), F.col("found").alias("_found"), F.coalesce(F.nullif("brand", F.lit("")), "manufacturer_name").alias("_owner"))
    joined = packages.join(renamed, F.col("barcode_value") == F.col("_gtin"), "left")
    new, filled = {}, []
    for p in fields:
        number = p in fixed.NUMBER_FIELDS
        blank = F.col(p).isNull() if number else ~truthy(F.col(p))
        has = F.col(f"_r_{p}").isNotNull() if number else truthy(F.col(f"_r_{p}"))
        new[p] = F.when(blank & has, F.col(f"_r_{p}")).otherwise(F.col(p))
        filled.append(F.when(blank & has, F.lit(p)))
    joined = joined.withColumn("filled_fields", F.filter(F.array(*filled), lambda x: x.isNotNull())).withColumns(new)
    known = joined.withColumn("product_identified", F.coalesce("_found", F.lit(False))).withColumn("product_data_sources", F.coalesce("_sources", F.array().cast("array<string>"))).withColumn("barcode_registered_owner", F.col("_owner"))
    return known.drop("_gtin", "_sources", "_found", "_owner", *[f"_r_{p}" for p in fields])
