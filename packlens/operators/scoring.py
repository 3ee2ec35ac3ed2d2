"""Scores, star bands, recommendations and report shapes from rule results, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .rules import STATUSES, bucket


def weight_of(results: Column) -> Column:
    return F.aggregate(results, F.lit(0.0), lambda total, r: total + r["weight"])


def severe(results: Column) -> Column:
    return F.filter(results, lambda r: r["severity"].isin("CRITICAL", "MAJOR"))


def of_severity(results: Column, severity: str) -> Column:
    return F.size(F.filter(results, lambda r: r["severity"] == severity))


def banded(score: Column, bands: list[tuple]) -> tuple[Column, Column]:
    """Stars and label of a score."""
    stars = label = None
    for least, n, text in bands:
        if least is None:
            return stars.otherwise(n), label.otherwise(text)
        stars = F.when(score >= least, n) if stars is None else stars.when(score >= least, n)
        label = F.when(score >= least, text) if label is None else label.when(score >= least, text)
    raise ValueError("bands need a last row without limit")


def rule_score(results: Column, unverified: bool = False) -> Column:
    """Passed weight over applicable weight, 1 if there is none; ``unverified`` counts inconclusive severe results as applicable."""
    passed = weight_of(bucket(results, "PASS"))
    all_weight = passed + weight_of(bucket(results, "FAIL")) + weight_of(bucket(results, "WARNING"))
    if unverified:
        all_weight = all_weight + weight_of(severe(bucket(results, "INCONCLUSIVE")))
    return F.when(all_weight > 0, passed / all_weight).otherwise(F.lit(1.0))


def failure_counts(results: Column) -> list[Column]:
    failed = bucket(results, "FAIL")
    return [of_severity(failed, s).alias(f"{s.lower()}_failures") for s in ("CRITICAL", "MAJOR", "MINOR")]


def label_scores(evaluated: DataFrame, model_probability: Column, share: float = fixed.MODEL_SHARE) -> DataFrame:
    """Scores of label audits: a blend of the model's probability and the rule score; inconclusive results don't count."""
    r = F.col("results")
    score = share * model_probability + (1 - share) * rule_score(r)
    stars, label = banded(F.col("final_score"), fixed.STAR_BANDS)
    applicable = F.size(bucket(r, "PASS")) + F.size(bucket(r, "FAIL")) + F.size(bucket(r, "WARNING"))
    scored = evaluated.withColumn("ebm_score", model_probability).withColumn("rule_score", rule_score(r)).withColumn("final_score", score)
    return scored.select(
        "*", stars.alias("star_rating"), label.alias("star_label"), applicable.alias("total_applicable_rules"),
        F.size(bucket(r, "PASS")).alias("passed_rules"), F.size(bucket(r, "FAIL")).alias("failed_rules"), *failure_counts(r))


def registry_scores(evaluated: DataFrame) -> DataFrame:
    """Scores of registry audits: severe results that couldn't be verified count as applicable; rounded, but banded before rounding."""
    r = F.col("results")
    unverified = F.size(severe(bucket(r, "INCONCLUSIVE")))
    scored = evaluated.withColumn("_score", rule_score(r, unverified=True))
    stars, label = banded(F.col("_score"), fixed.STAR_BANDS)
    named = F.when(unverified > 0, F.format_string("%s — %d mandatory declarations unverified", label, unverified)).otherwise(label)
    applicable = F.size(bucket(r, "PASS")) + F.size(bucket(r, "FAIL")) + F.size(bucket(r, "WARNING")) + unverified
    risks = F.slice(F.transform(bucket(r, "FAIL"), lambda x: x["rule_id"]), 1, 5)
    return scored.select(
        "*", F.round("_score", 3).alias("final_score"), stars.alias("star_rating"), named.alias("star_label"),
        applicable.alias("total_applicable_rules"), F.size(bucket(r, "PASS")).alias("passed_rules"), F.size(bucket(r, "FAIL")).alias("failed_rules"),
        *failure_counts(r), unverified.alias("unverified"), (F.col("_score") >= fixed.COMPLIANT_FROM).alias("predicted_compliant"), risks.alias("top_risk_factors"),
    ).drop("_score")


def reading_scores(readings: DataFrame) -> DataFrame:
    """Scores that a language model gives: percent above 1; counted from its results if it gives none."""
    r, raw = F.col("results"), F.coalesce("compliance_score", F.lit(0.0))
    passed, failed, warned = (F.size(bucket(r, s)) for s in ("PASS", "FAIL", "WARNING"))
    counted = F.when(passed + failed + warned > 0, passed / (passed + failed + warned)).otherwise(F.lit(1.0))
    score = F.when(raw > 1, raw / 100).when((raw <= 0) & (passed + failed > 0), counted).otherwise(raw)
    scored = readings.withColumn("_score", score)
    stars, label = banded(F.col("_score") * 100, fixed.MODEL_STAR_BANDS)
    return scored.select("*", F.round("_score", 3).alias("final_score"), stars.alias("star_rating"), label.alias("star_label"), passed.alias("passed_rules"), failed.alias("failed_rules"), *failure_counts(r)).drop("_score")


def recommendations(results: Column) -> Column:
    """A line for each failure, then for each warning; one fixed line if there are none. Needs wide results."""
    def failure(x: Column) -> Column:
        reference = F.when(F.coalesce(x["legal_reference"], F.lit("")) != "", F.concat(F.lit(" (Ref: "), x["legal_reference"], F.lit(")"))).otherwise("")
        evidence = F.when(F.coalesce(x["evidence"], F.lit("")) != "", F.concat(F.lit(" Found: "), x["evidence"])).otherwise("")
        return F.concat(F.lit("["), x["severity"], F.lit("] "), x["rule_name"], reference, F.lit(": "), x["detail"], F.lit("."), evidence)

    def warning(x: Column) -> Column:
        return F.concat(F.lit("[WARNING] "), x["rule_name"], F.lit(": "), x["detail"], F.lit("."))

    lines = F.concat(F.transform(bucket(results, "FAIL"), failure), F.transform(bucket(results, "WARNING"), warning))
    return F.when(F.size(lines) == 0, F.array(F.lit(fixed.NOTHING_FOUND))).otherwise(lines)


def registry_recommendations(results: Column, is_found: Column) -> Column:
    """Recommendations of a registry audit: first that the product is unknown, then what to inspect, then the rest."""
    open_ = severe(bucket(results, "INCONCLUSIVE"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(open_, lambda x: x["rule_name"]))), ", ")
    action = F.when(F.size(open_) > 0, F.format_string(fixed.UNVERIFIED, F.size(open_), names))
    info = F.when(~is_found, F.lit(fixed.NOT_REGISTERED))
    return F.concat(F.filter(F.array(info, action), lambda x: x.isNotNull()), recommendations(results))


def report_rows(rows: DataFrame) -> DataFrame:
    """Exploded wide results in report order: by bucket, then by rule; texts shortened as the report table has them."""
    from ..functions.text import shortened

    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0)), F.lit(len(STATUSES)))
    return rows.select("*", rank.cast("int").alias("bucket_no"), F.substring("rule_id", 1, 20).alias("id_cell"), shortened(F.col("rule_name"), 30).alias("name_cell"), shortened(F.col("detail"), 40).alias("detail_cell"))


def star_text(stars: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), stars), F.repeat(F.lit("☆"), 5 - stars))


def percent_text(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def report_json(*columns: str) -> Column:
    """The row's columns as indented JSON."""
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def console_report(name: Column, lines: Column) -> Column:
    """The report of a scored package as text for a console; ``lines`` are its recommendations. Needs wide results."""
    rule = F.lit("=" * 60)
    head = F.array(
        rule, F.concat(F.lit("COMPLIANCE REPORT — "), name), rule, F.concat(F.lit("Rating: "), star_text(F.col("star_rating")), F.lit(" ("), F.col("star_label"), F.lit(")")),
        F.concat(F.lit("Score: "), percent_text(F.col("final_score"))), F.concat(F.lit("Rules: "), F.col("passed_rules").cast("string"), F.lit(" passed, "), F.col("failed_rules").cast("string"), F.lit(" failed")))
    failed = F.transform(bucket(F.col("results"), "FAIL"), lambda r: F.concat(F.lit("  - ["), r["severity"], F.lit("] "), r["rule_name"], F.lit(": "), r["detail"]))
    failures = F.when(F.size(failed) > 0, F.concat(F.array(F.lit(""), F.lit("Failures:")), failed)).otherwise(F.array().cast("array<string>"))
    advice = F.concat(F.array(F.lit(""), F.lit("Recommendations:")), F.transform(lines, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)))
    return F.array_join(F.concat(head, failures, advice, F.array(rule)), "\n")


def stamped(scored: DataFrame) -> DataFrame:
    """Adds ``scan_id``, eight random hexadecimal digits, and ``scan_timestamp``; another run gives others, so write what is stamped before it is used twice."""
    return scored.withColumns({"scan_id": F.substring(F.uuid(), 1, 8), "scan_timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})


def analysis_mode(contributions: Column) -> Column:
    """How a verdict came about, by what contributed to it; the first that applies."""
    has = lambda k: F.coalesce(F.map_contains_key(contributions, k), F.lit(False))
    return F.when(has("barcode_registry_analysis"), "barcode_registry").when(has("llm_barcode_analysis"), "llm_barcode").when(has("llm_vision_analysis"), "llm_vision").otherwise("local_ocr")


def payload() -> Column:
    """The service's answer for a package: scores in percent, results by bucket, bar code and product."""
    r = F.col("results")

    def shown(status: str) -> Column:
        return F.transform(bucket(r, status), lambda x: F.struct(x["rule_id"].alias("rule_id"), x["rule_name"].alias("rule_name"), x["severity"].alias("severity"), x["detail"].alias("detail")))

    quantity = F.when(F.col("net_quantity_value").isNotNull(), F.trim(F.concat_ws(" ", F.col("net_quantity_value").cast("string"), F.coalesce("net_quantity_unit", F.lit("None")))))
    return F.struct(
        F.struct(F.round(F.col("final_score") * 100, 1).alias("final_score"), "star_rating", "star_label", "passed_rules", "failed_rules").alias("score"),
        F.struct(*[shown(s).alias(n) for s, n in zip(STATUSES, ("passed", "failed", "warnings", "not_applicable", "inconclusive"), strict=True)]).alias("rules"),
        F.struct("has_barcode", F.col("barcode_value").alias("value"), F.col("barcode_gtin_format").alias("gtin_format"), F.col("barcode_checksum_valid").alias("checksum_valid"), F.col("barcode_country").alias("country"), F.col("barcode_is_gs1_india").alias("is_gs1_india"), F.col("barcode_is_restricted").alias("is_restricted")).alias("barcode"),
        F.struct(F.col("product_identified").alias("identified"), F.col("product_data_sources").alias("sources"), F.col("commodity_name").alias("name"), F.col("manufacturer_name").alias("manufacturer"), quantity.alias("net_quantity"), F.col("mrp_value").alias("mrp"), "country_of_origin").alias("product"),
    )
