"""Answers of language models: the first of an ordered list that can be read, and its rules in shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_value, truthy

#: What an answer may hold; all else is ignored.
READING = (
    "product_name string, compliance_score double, declarations struct<mrp_value:double, net_quantity_value:double, net_quantity_unit:string, dates:string, manufacture_date:string, "
    "consumer_care:string, consumer_care_email:string, barcode_printed:string>, rules array<struct<rule_id:string, rule_name:string, status:string, severity:string, weight:double, detail:string>>"
)


def without_fences(text: Column) -> Column:
    """Markdown fences around JSON taken off."""
    opened = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```json\s*", ""), r"^```\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def answer_text(body: Column) -> Column:
    """The text of a service's answer: the first part of its first candidate."""
    return F.get_json_object(body, "$.candidates[0].content.parts[0].text")


def shaped_rules(rules: Column) -> Column:
    """Rules as results: a missing id is RULE, a missing name is the id; states and severities in capitals, INCONCLUSIVE and MINOR where missing; weight 1."""
    def one(r: Column) -> Column:
        name = F.coalesce(r["rule_name"], r["rule_id"], F.lit("Rule"))
        return F.struct(
            F.coalesce(r["rule_id"], F.lit("RULE")).alias("rule_id"), name.alias("rule_name"), F.upper(F.coalesce(r["status"], F.lit("INCONCLUSIVE"))).alias("status"),
            F.upper(F.coalesce(r["severity"], F.lit("MINOR"))).alias("severity"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight"), F.coalesce(r["detail"], F.lit("")).alias("detail"))

    return F.coalesce(F.transform(rules, one), F.array().cast("array<struct<rule_id:string,rule_name:string,status:string,severity:string,weight:double,detail:string>>"))


def first_readings(answers: DataFrame) -> DataFrame:
    """``request_id, model_no, j, results, error``: of each request the answer of the first model that can be read.

    ``answers(request_id, model_no, status, body)`` are what the models of an ordered
    list have said. An answer counts if its status is 200, it has a text, and this is JSON
    inside its fences. One aggregation by request; rows combine before the shuffle. A request without any
    has null but for ``error``, what its last model came to; ``results`` are the rules in shape.
    """
    text = without_fences(answer_text(F.col("body")))
    read = F.when(F.col("status") == 200, F.when(json_value(text).isNotNull(), text))
    reason = F.when(F.coalesce(F.col("status"), F.lit(0)) != 200, F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).when(~truthy(text), F.lit("no text")).otherwise(F.lit("no JSON"))
    held = answers.select("request_id", "model_no", read.alias("_text"), reason.alias("_reason"))
    got = held.groupBy("request_id").agg(
        F.min_by("_text", F.when(F.col("_text").isNotNull(), F.col("model_no"))).alias("_text"), F.min(F.when(F.col("_text").isNotNull(), F.col("model_no"))).alias("model_no"), F.max_by("_reason", "model_no").alias("_reason"))
    j = F.from_json("_text", READING)
    return got.select("request_id", "model_no", j.alias("j"), F.when(F.col("_text").isNotNull(), shaped_rules(j["rules"])).alias("results"), F.when(F.col("_text").isNull(), F.col("_reason")).alias("error"))
