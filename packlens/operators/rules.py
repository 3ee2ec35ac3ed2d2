"""The rulebook as Column expressions over a package row.

A rule is an ordered list of outcomes; the first whose condition holds decides.
``results`` builds one array of structs per package: narrow ones (rule, status,
severity, weight) for scoring, wide ones with texts for reports. Only the rules
that are asked for are built, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checked import Checked, first_error
from ..functions.fixed import RULE_FAILED
from ..functions.geometry import least_height
from ..functions.text import first_truthy, strip, truthy
from .rule_texts import ABSENT, ABSENT_LABEL, ABSENT_REGISTRY, CONSTANT, NAMES, TEXTS, VISUAL

STATUSES = ["PASS", "FAIL", "WARNING", "NOT_APPLICABLE", "INCONCLUSIVE"]


@dataclass(frozen=True)
class Outcome:
    when: Column | None  # None: otherwise
    status: str | Column
    severity: str
    weight: float
    detail: Column
    evidence: Column | None = None
    reference: str | None = None


@dataclass(frozen=True)
class Rule:
    """A rule of the rulebook, or one of a user's own, with its ``title``.

    ``checks`` are the values that may go wrong on a row: where one has an error, the
    rule is inconclusive on that row, and its outcomes aren't looked at.
    """

    rule_id: str
    outcomes: Callable[[], list[Outcome]]
    title: str | None = None
    checks: Callable[[], list[Checked]] | None = None

    @property
    def name(self) -> str:
        return self.title if self.title is not None else NAMES[self.rule_id]


RULES: list[Rule] = []


def rule(rule_id: str) -> Callable:
    def keep(outcomes: Callable[[], list[Outcome]]) -> Callable:
        RULES.append(Rule(rule_id, outcomes))
        return outcomes

    return keep


def say(key: str, *values: Column) -> Column:
    """A fixed text with values put in; a null value prints as None."""
    if not values:
        return F.lit(TEXTS[key])
    shown = [F.coalesce(v, F.lit("None")) if "%s" in TEXTS[key] else v for v in values]
    return F.format_string(TEXTS[key], *shown)


def number(value: Column) -> Column:
    return value.cast("string")


c = F.col


def from_registry() -> Column:
    return c("analysis_source") == "barcode_registry"


def unseen() -> Outcome:
    """No image: what has to be seen can't be judged."""
    return Outcome(from_registry(), "NOT_APPLICABLE", "MAJOR", 0.0, F.lit(VISUAL))


def absent(rule_id: str, severity: str, weight: float) -> Outcome:
    """A missing declaration fails on a label; a registry may just not carry it."""
    what, reference = ABSENT[rule_id]
    status = F.when(from_registry(), "INCONCLUSIVE").otherwise("FAIL")
    detail = F.when(from_registry(), F.lit(ABSENT_REGISTRY.replace("%s", what))).otherwise(F.lit(ABSENT_LABEL.replace("%s", what)))
    return Outcome(None, status, severity, weight, detail, None, reference)


def constant(rule_id: str) -> None:
    status, severity, text, reference = CONSTANT[rule_id]
    RULES.append(Rule(rule_id, lambda: [Outcome(None, status, severity, 0.0, F.lit(text), None, reference)]))


@rule("R03_SCOPE")
def _():
    unit = F.lower(F.coalesce(c("net_quantity_unit"), F.lit("")))
    return [
        Outcome(c("package_type") == "wholesale", "NOT_APPLICABLE", "MINOR", 0.0, say("scope_wholesale")),
        Outcome((c("net_quantity_value") > 25) & unit.isin("kg", "l", "litre", "liter"), "FAIL", "MAJOR", 0.5, say("scope_over", number(c("net_quantity_value")), unit), None, "Rule 3"),
        Outcome(None, "PASS", "MINOR", 0.25, say("scope_pass")),
    ]


constant("R26_EXEMPTION")


@rule("R05_STD_QTY")
def _():
    return [
        Outcome(c("net_quantity_value").isNull(), "INCONCLUSIVE", "MAJOR", 0.5, say("standard_none")),
        Outcome(None, "INCONCLUSIVE", "MAJOR", 0.5, say("standard_open"), None, "Rule 5 / Second Schedule"),
    ]


@rule("R06_NAME")
def _():
    name = c("commodity_name")
    return [Outcome(truthy(name), "PASS", "CRITICAL", 1.0, say("name_pass", name), name), absent("R06_NAME", "CRITICAL", 1.0)]


@rule("R10_MFR_NAME")
def _():
    name = first_truthy(c("manufacturer_name"), c("packer_name"), c("importer_name"))
    return [Outcome(name.isNotNull(), "PASS", "CRITICAL", 1.0, say("party_pass", name), name), absent("R10_MFR_NAME", "CRITICAL", 1.0)]


@rule("R10_ADDRESS")
def _():
    address = first_truthy(c("manufacturer_address"), c("packer_address"), c("importer_address"))
    return [Outcome(F.length(strip(address)) > 10, "PASS", "CRITICAL", 1.0, say("address_pass"), address), absent("R10_ADDRESS", "CRITICAL", 1.0)]


@rule("R11_NET_QTY")
def _():
    value, unit = number(c("net_quantity_value")), c("net_quantity_unit")
    return [Outcome(value.isNotNull(), "PASS", "CRITICAL", 1.0, say("quantity_pass", value, unit), say("quantity_value", value, unit)), absent("R11_NET_QTY", "CRITICAL", 1.0)]


@rule("R13_UNITS")
def _():
    unit, category = c("net_quantity_unit"), c("net_quantity_category")
    return [
        Outcome(truthy(unit) & truthy(category), "PASS", "MAJOR", 0.5, say("unit_pass", unit, category), unit),
        Outcome(truthy(unit), "WARNING", "MAJOR", 0.5, say("unit_warning", unit), unit),
        absent("R13_UNITS", "MAJOR", 0.5),
    ]


@rule("R12_QTY_FMT")
def _():
    return [
        Outcome(c("net_quantity_value").isNotNull() & truthy(c("net_quantity_unit")), "PASS", "MAJOR", 0.5, say("format_pass")),
        Outcome(None, "INCONCLUSIVE", "MAJOR", 0.5, say("format_open"), None, "Rule 12"),
    ]


@rule("R06_MRP")
def _():
    value = c("mrp_value")
    return [Outcome(value.isNotNull(), "PASS", "CRITICAL", 1.0, say("price_pass", value), say("price_value", value)), absent("R06_MRP", "CRITICAL", 1.0)]


@rule("R06_MRP_TAX")
def _():
    tax = c("mrp_includes_tax")
    return [
        Outcome(c("mrp_value").isNull(), "INCONCLUSIVE", "MAJOR", 0.5, say("tax_none"), None, "Rule 6(1)(e)"),
        Outcome(tax, "PASS", "MAJOR", 0.5, say("tax_pass"), None, "Rule 6(1)(e)"),
        Outcome(from_registry() | tax.isNull(), "INCONCLUSIVE", "MAJOR", 0.5, say("tax_open"), None, "Rule 6(1)(e)"),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("tax_fail"), None, "Rule 6(1)(e)"),
    ]


@rule("R06_COO")
def _():
    country, reference = c("country_of_origin"), "Rule 6 (imported packages)"
    return [
        Outcome(truthy(country), "PASS", "MAJOR", 0.5, say("origin_pass", country), country, reference),
        Outcome(c("is_imported"), "FAIL", "MAJOR", 0.5, say("origin_fail"), None, reference),
        Outcome(None, "NOT_APPLICABLE", "MINOR", 0.0, say("origin_none"), None, reference),
    ]


@rule("R18_MRP_ALTER")
def _():
    return [
        unseen(),
        Outcome(c("mrp_altered"), "FAIL", "CRITICAL", 1.0, say("altered_fail"), None, "Rule 18"),
        Outcome(None, "PASS", "CRITICAL", 1.0, say("altered_pass")),
    ]


@rule("R06_DATE")
def _():
    date = first_truthy(c("manufacture_date"), c("best_before"))
    return [Outcome(date.isNotNull(), "PASS", "MAJOR", 0.5, say("date_pass", date), date), absent("R06_DATE", "MAJOR", 0.5)]


@rule("R06_CONSUMER")
def _():
    contact = first_truthy(c("consumer_care_phone"), c("consumer_care_email"))
    return [Outcome(contact.isNotNull(), "PASS", "MAJOR", 0.5, say("care_pass"), contact), absent("R06_CONSUMER", "MAJOR", 0.5)]


@rule("R09_LEGIBLE")
def _():
    confidence = c("average_ocr_confidence")
    return [
        unseen(),
        Outcome(confidence == 0, "INCONCLUSIVE", "MAJOR", 0.5, say("legible_none")),
        Outcome(confidence >= 0.4, "PASS", "MAJOR", 0.5, say("legible_pass", confidence * 100)),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("legible_fail", confidence * 100), None, "Rule 9"),
    ]


@rule("R09_CONTRAST")
def _():
    ratio = F.coalesce(F.nullif(c("mrp_contrast_ratio"), F.lit(0.0)), c("net_qty_contrast_ratio"))
    return [
        unseen(),
        Outcome(ratio.isNull(), "INCONCLUSIVE", "MAJOR", 0.5, say("contrast_none")),
        Outcome(ratio >= 3.0, "PASS", "MAJOR", 0.5, say("contrast_pass", ratio), say("contrast_value", ratio)),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("contrast_fail", ratio), None, "Rule 9"),
    ]


@rule("R08_PDP")
def _():
    return [
        unseen(),
        Outcome(c("declarations_on_principal_panel"), "PASS", "MAJOR", 0.5, say("panel_pass")),
        Outcome(None, "WARNING", "MAJOR", 0.5, say("panel_warning"), None, "Rule 8"),
    ]


@rule("R08_CLEAR")
def _():
    above, below, left, right = (c(f"net_qty_clear_space_{side}_mm") for side in ("above", "below", "left", "right"))
    height = c("net_qty_font_height_mm")
    vertical = (above >= height) & (below >= height)
    horizontal = (left >= 2 * height) & (right >= 2 * height)
    short = F.concat(
        F.lit(TEXTS["clear_fail"]),
        F.when(vertical, "").otherwise(say("clear_vertical", above, below, height)),
        F.when(horizontal, "").otherwise(say("clear_horizontal", left, right, 2 * height)),
    )
    unknown = above.isNull() | below.isNull() | left.isNull() | right.isNull() | height.isNull()
    return [
        unseen(),
        Outcome(unknown, "INCONCLUSIVE", "MINOR", 0.25, say("clear_none")),
        Outcome(vertical & horizontal, "PASS", "MINOR", 0.25, say("clear_pass")),
        Outcome(None, "FAIL", "MINOR", 0.25, short, None, "Rule 8"),
    ]


@rule("R07_FONT")
def _():
    price, quantity, area = c("mrp_font_height_mm"), c("net_qty_font_height_mm"), c("principal_display_panel_area_mm2")
    least = F.when(F.coalesce(area, F.lit(0.0)) != 0, least_height(area / 100)).otherwise(F.lit(1.0))
    short = F.concat_ws("; ", F.when(price < least, say("font_price", price, least)), F.when(quantity < least, say("font_quantity", quantity, least)))
    return [
        unseen(),
        Outcome(price.isNull() & quantity.isNull(), "INCONCLUSIVE", "MAJOR", 0.5, say("font_none")),
        Outcome((price < least) | (quantity < least), "FAIL", "MAJOR", 0.5, short, say("font_value", number(price), number(quantity)), "Rule 7"),
        Outcome(None, "PASS", "MAJOR", 0.5, say("font_pass", least)),
    ]


constant("R09_LIQUID")
constant("R09_WRAPPER")


@rule("R09_LANG")
def _():
    hindi, english = c("has_hindi_text"), c("has_english_text")
    named = F.concat_ws(", ", F.when(english, "English"), F.when(hindi, "Hindi"))
    return [
        unseen(),
        Outcome(hindi | english, "PASS", "MAJOR", 0.5, say("language_pass", named)),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("language_fail"), None, "Rule 9"),
    ]


for _id in ("R23_DECEPTIVE", "R22_MPE", "R19_STAT_AVG", "R19_IND_MPE", "R19_SAMPLE"):
    constant(_id)


@rule("R24_WHOLESALE")
def _():
    named = truthy(c("manufacturer_name")) | truthy(c("importer_name"))
    return [
        Outcome(c("package_type") != "wholesale", "NOT_APPLICABLE", "MAJOR", 0.0, say("wholesale_none")),
        Outcome(named & c("net_quantity_value").isNotNull(), "PASS", "MAJOR", 0.5, say("wholesale_pass")),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("wholesale_fail"), None, "Rule 24"),
    ]


@rule("R25_EXPORT")
def _():
    return [
        Outcome(~c("is_imported"), "NOT_APPLICABLE", "CRITICAL", 0.0, say("export_none")),
        Outcome(truthy(c("importer_name")) & truthy(c("importer_address")), "PASS", "CRITICAL", 1.0, say("export_pass")),
        Outcome(None, "FAIL", "CRITICAL", 1.0, say("export_fail"), None, "Rule 25"),
    ]


constant("R27_REG")
constant("R31_AD")

LABEL_RULES = [r.rule_id for r in RULES]
CODE_REFERENCE = "Rule 6(10)"


@rule("B01_GTIN_STRUCT")
def _():
    code, kind = c("barcode_value"), c("barcode_gtin_format")
    return [
        Outcome(~c("has_barcode") | ~truthy(code), "NOT_APPLICABLE", "MINOR", 0.0, say("struct_none"), None, CODE_REFERENCE),
        Outcome(truthy(kind), "PASS", "MINOR", 0.25, say("struct_pass", kind), code, CODE_REFERENCE),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("struct_fail", code), code, CODE_REFERENCE),
    ]


@rule("B02_GTIN_CHECKSUM")
def _():
    right, code = c("barcode_checksum_valid"), c("barcode_value")
    return [
        Outcome(right.isNull(), "INCONCLUSIVE", "MINOR", 0.25, say("check_none"), None, CODE_REFERENCE),
        Outcome(right, "PASS", "MINOR", 0.25, say("check_pass"), code, CODE_REFERENCE),
        Outcome(None, "FAIL", "MAJOR", 0.5, say("check_fail"), code, CODE_REFERENCE),
    ]


@rule("B03_GTIN_SCOPE")
def _():
    code = c("barcode_value")
    reason = F.coalesce(F.nullif(c("barcode_restricted_reason"), F.lit("")), F.lit(TEXTS["trade_range"]))
    return [
        Outcome(~truthy(code), "NOT_APPLICABLE", "MINOR", 0.0, say("trade_none"), None, CODE_REFERENCE),
        Outcome(c("barcode_is_restricted"), "FAIL", "MAJOR", 0.5, say("trade_fail", reason), code, CODE_REFERENCE),
        Outcome(None, "PASS", "MINOR", 0.25, say("trade_pass"), None, CODE_REFERENCE),
    ]


@rule("B04_GS1_AUTHORITY")
def _():
    country = c("barcode_country")
    return [
        Outcome(~truthy(country), "WARNING", "MINOR", 0.25, say("authority_none")),
        Outcome(c("barcode_is_gs1_india"), "PASS", "MINOR", 0.25, say("authority_india"), say("authority_india_value")),
        Outcome(None, "PASS", "MINOR", 0.25, say("authority_pass", country), country),
    ]


@rule("B05_REGISTRY_ID")
def _():
    sources = F.array_join(F.coalesce(c("product_data_sources"), F.array().cast("array<string>")), ", ")
    return [
        Outcome(c("product_identified"), "PASS", "MAJOR", 0.5, say("registry_pass", sources), F.nullif(c("barcode_registered_owner"), F.lit("")), "Rule 6(1)(a)"),
        Outcome(None, "WARNING", "MAJOR", 0.5, say("registry_warning"), None, "Rule 6(1)(a)"),
    ]


@rule("B06_ORIGIN_CONSISTENCY")
def _():
    declared, economy = strip(F.coalesce(c("country_of_origin"), F.lit(""))), c("barcode_country")
    apart = ~F.lower(economy).contains(F.lower(declared)) & ~F.lower(declared).contains(F.lower(economy))
    return [
        Outcome(declared == "", "NOT_APPLICABLE", "MINOR", 0.0, say("match_none"), None, "Rule 6"),
        Outcome(truthy(economy) & apart, "WARNING", "MINOR", 0.25, say("match_warning", declared, economy), say("match_value", declared, economy), "Rule 6"),
        Outcome(None, "PASS", "MINOR", 0.25, say("match_pass", declared), declared, "Rule 6"),
    ]


CODE_RULES = [r.rule_id for r in RULES if r.rule_id not in LABEL_RULES]
BY_ID = {r.rule_id: r for r in RULES}
ORDER = {r.rule_id: i for i, r in enumerate(RULES, 1)}


def fields_of(one: Rule, status: Column, severity: str, weight: float, wide: bool, detail: Column, evidence: Column | None, reference: str | None) -> Column:
    fields = [F.lit(ORDER.get(one.rule_id, len(ORDER) + 1)).alias("rule_no"), F.lit(one.rule_id).alias("rule_id"), status.alias("status"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight")]
    if wide:
        none = F.lit(None).cast("string")
        fields += [F.lit(one.name).alias("rule_name"), detail.alias("detail"), (none if evidence is None else evidence).alias("evidence"), F.lit(reference).cast("string").alias("legal_reference")]
    return F.struct(*fields)


def failed(one: Rule, reason: Column, wide: bool) -> Column:
    """What a rule gives that can't be evaluated: inconclusive, of no weight, with the reason."""
    return fields_of(one, F.lit("INCONCLUSIVE"), "MINOR", 0.0, wide, F.concat(F.lit(RULE_FAILED), reason), None, None)


def result_of(one: Rule, wide: bool) -> Column:
    """The struct of a rule's deciding outcome."""

    def struct(o: Outcome) -> Column:
        return fields_of(one, F.lit(o.status) if isinstance(o.status, str) else o.status, o.severity, o.weight, wide, o.detail, o.evidence, o.reference)

    error = first_error(*one.checks()) if one.checks else None
    result = None if error is None else F.when(error.isNotNull(), failed(one, error, wide))
    for o in one.outcomes():
        if o.when is None:
            return struct(o) if result is None else result.otherwise(struct(o))
        result = F.when(o.when, struct(o)) if result is None else result.when(o.when, struct(o))
    raise ValueError(f"{one.rule_id} has no last outcome")


def resolvable(packages: DataFrame, results: list[Column]) -> str | None:
    """Why Spark can't resolve ``results`` on ``packages``, in one line, or None; nothing is run for that."""
    try:
        packages.select(*[r.alias(f"_r{i}") for i, r in enumerate(results)])
    except AnalysisException as e:
        return str(e).splitlines()[0]
    return None


def chosen(rule_ids: Iterable[str] | None, code_rules: bool) -> list[Rule]:
    wanted = list(rule_ids) if rule_ids is not None else [*LABEL_RULES, *(CODE_RULES if code_rules else [])]
    unknown = [r for r in wanted if r not in BY_ID]
    if unknown:
        raise ValueError(f"no such rules: {', '.join(unknown)}")
    return [BY_ID[r] for r in wanted]


def with_results(packages: DataFrame, rule_ids: Iterable[str] | None = None, code_rules: bool = True, wide: bool = False, extra: Column | None = None, isolate: bool = False, own: Iterable[Rule] = ()) -> DataFrame:
    """``packages`` with ``results``, an array with a struct for each rule.

    ``code_rules`` adds the bar-code rules for packages that have a bar code or
    come from a registry; ``rule_ids`` picks rules instead. ``extra`` is an array of
    like structs to append, ``own`` are further rules. With ``isolate``, a rule that can't be
    resolved on this table is inconclusive, of no weight, and says why; otherwise it
    fails the query. What goes wrong on single rows is the matter of a rule's
    ``checks``; the rulebook's own expressions can't fail on any row.
    """
    asked = [*chosen(rule_ids, False), *own]
    by_code = [BY_ID[r] for r in CODE_RULES] if rule_ids is None and code_rules else []
    judged = {one: result_of(one, wide) for one in [*asked, *by_code]}
    if isolate and resolvable(packages, list(judged.values())):  # one analysis if all can be resolved
        for one, result in judged.items():
            if reason := resolvable(packages, [result]):
                judged[one] = failed(one, F.lit(reason), wide)
    results = F.array(*[judged[one] for one in asked])
    if by_code:
        results = F.when(c("has_barcode") | from_registry(), F.concat(results, F.array(*[judged[one] for one in by_code]))).otherwise(results)
    return packages.withColumn("results", F.concat(results, extra) if extra is not None else results)


def exploded(evaluated: DataFrame, key: str = "package_id") -> DataFrame:
    """One row per package and rule."""
    return evaluated.select(key, F.explode("results").alias("_r")).select(key, "_r.*")


def bucket(results: Column, status: str) -> Column:
    """The results of a status; what is none of the first four is inconclusive."""
    if status == "INCONCLUSIVE":
        return F.filter(results, lambda r: ~r["status"].isin(*STATUSES[:4]))
    return F.filter(results, lambda r: r["status"] == status)


def counts(results: Column) -> list[Column]:
    """How many results each bucket has, and in all."""
    return [*[F.size(bucket(results, s)).alias(s.lower()) for s in STATUSES], F.size(results).alias("total")]


def summary(results: Column) -> Column:
    """A short text of the counts."""
    return F.concat_ws(", ", *[F.format_string(f"{s}: %d", F.size(bucket(results, s))) for s in STATUSES])
