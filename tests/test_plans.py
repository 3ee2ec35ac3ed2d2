"""How often the text of a label is searched, and what a rule that can't be evaluated gives."""

from packlens.operators import rules
from packlens.plans import queries
from packlens.sources import tables

SF = "/root/testdata/sf0.001"


def test_each_pattern_is_searched_once_a_label(spark):
    plan = queries.label_declarations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(name) for name in ("regexp_extract", "regexp_replace", "regexp_instr", "rlike", "RLIKE")) < 80
    assert len(plan) < 40_000


def test_a_failing_rule_fails_alone(spark):
    table = tables.packages(spark, SF).where("analysis_source = 'image'").drop("mrp_value")
    found = {r.rule_id: r for r in rules.exploded(rules.with_results(table, isolate=True, wide=True)).limit(38).collect()}
    assert found["R06_MRP"].status == "INCONCLUSIVE" and "mrp_value" in found["R06_MRP"].detail
    assert found["R06_NAME"].status != "INCONCLUSIVE"


def test_extra_results_are_appended(spark):
    held = rules.with_results(tables.packages(spark, SF), rule_ids=["R06_MRP"])
    again = rules.with_results(held, rule_ids=["R06_NAME"], extra=held["results"])
    assert [r.rule_id for r in again.first().results] == ["R06_NAME", "R06_MRP"]
