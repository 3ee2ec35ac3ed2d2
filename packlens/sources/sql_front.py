"""The library from SQL text: temporary views of its tables, and its functions as SQL functions.

``register(spark, sf_dir)`` makes both in a session; after it,

    SELECT package_id, f.format, f.is_valid FROM (SELECT package_id, gtin_facts(code) AS f FROM codes)
    SELECT image_id, label_quantity(label_text(text)).value FROM label_texts
    SELECT line_no, line FROM label_texts, LATERAL label_lines(text)

run on the JVM like any other SQL: functions are SQL expressions that the
optimizer inlines, and no Python takes part.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import fixed
from ..functions.text import ANY_CASE, UNICODE
from ..operators import packages, rules, scoring
from . import tables


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(text: str, ignore_case: bool = True) -> str:
    return literal((ANY_CASE if ignore_case else UNICODE) + text)


def hit(text: str, pattern: str, group: int = 0, ignore_case: bool = True) -> str:
    return f"nullif(regexp_extract({text}, {regex(pattern, ignore_case)}, {group}), '')"


def cases(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {literal(k) if isinstance(k, str) else k} THEN {literal(v)}" for k, v in values.items()) + " END"


def ranges(held: list[tuple[int, int, str]], number: str) -> str:
    """The text of the first range that holds a number."""
    rows = ", ".join(f"named_struct('low', {low}, 'high', {high}, 'text', {literal(text)})" for low, high, text in held)
    return f"get(filter(array({rows}), r -> {number} BETWEEN r.low AND r.high), 0).text"


TRIM = r"regexp_replace({0}, '(?U)^\\s+|\\s+$', '')"
FACTS = "STRUCT<digits STRING, length INT, format STRING, is_gtin_length BOOLEAN, checksum_valid BOOLEAN, prefix STRING, country STRING, is_india BOOLEAN, is_restricted BOOLEAN, restricted_reason STRING, gtin14 STRING, is_valid BOOLEAN, notes ARRAY<STRING>>"


def functions() -> list[tuple[str, str, str, str]]:
    """``name, parameters, type, body`` of each SQL function, those that others use first."""
    parts = ", ".join(hit("raw", fixed.NET_QUANTITY, i) for i in range(1, 10))
    return [
        ("gtin_digits", "code STRING", "STRING", f"coalesce(regexp_replace({TRIM.format('code')}, '[^0-9]', ''), '')"),
        ("gtin_check_digit", "body STRING", "INT", "CASE WHEN length(body) > 0 THEN (10 - aggregate(sequence(1, length(body)), 0, (total, i) -> total + CAST(substring(reverse(body), i, 1) AS INT) * if(i % 2 = 1, 3, 1)) % 10) % 10 END"),
        ("gtin_format", "digits STRING", "STRING", cases(fixed.GTIN_NAMES, "length(digits)")),
        ("gtin_checks", "digits STRING", "BOOLEAN", "CASE WHEN gtin_format(digits) IS NULL THEN false ELSE gtin_check_digit(substring(digits, 1, length(digits) - 1)) = CAST(substring(digits, length(digits), 1) AS INT) END"),
        ("gtin_prefix", "digits STRING", "STRING", "CASE WHEN gtin_format(digits) IS NOT NULL AND length(digits) <> 8 THEN substring(lpad(digits, 14, '0'), 2, 3) END"),
        ("gtin_economy", "prefix INT", "STRING", ranges(fixed.PREFIX_ECONOMIES, "prefix")),
        ("gtin_reserved_for", "prefix INT", "STRING", ranges(fixed.RESERVED_PREFIXES, "prefix")),
        ("gtin_facts_of", "digits STRING, form STRING, checked BOOLEAN, prefix STRING, economy STRING, reason STRING", FACTS,
         f"""named_struct('digits', digits, 'length', length(digits), 'format', form, 'is_gtin_length', form IS NOT NULL, 'checksum_valid', checked, 'prefix', prefix, 'country', economy,
         'is_india', coalesce(prefix = {literal(fixed.INDIA_PREFIX)}, false), 'is_restricted', reason IS NOT NULL, 'restricted_reason', reason, 'gtin14', CASE WHEN form IS NOT NULL THEN lpad(digits, 14, '0') END,
         'is_valid', form IS NOT NULL AND checked AND reason IS NULL, 'notes', filter(array(CASE WHEN form IS NULL THEN format_string({literal(fixed.NOTE_LENGTH)}, length(digits)) WHEN NOT checked THEN {literal(fixed.NOTE_CHECK)} END,
         CASE WHEN reason IS NOT NULL THEN format_string({literal(fixed.NOTE_RESERVED)}, prefix, reason) END, CASE WHEN prefix = {literal(fixed.INDIA_PREFIX)} THEN {literal(fixed.NOTE_INDIA)} END), x -> x IS NOT NULL))"""),
        ("gtin_facts_by", "digits STRING, prefix STRING", FACTS, "gtin_facts_of(digits, gtin_format(digits), gtin_checks(digits), prefix, gtin_economy(CAST(prefix AS INT)), gtin_reserved_for(CAST(prefix AS INT)))"),
        ("gtin_facts", "code STRING", FACTS, "gtin_facts_by(gtin_digits(code), gtin_prefix(gtin_digits(code)))"),
        ("label_text", "text STRING", "STRING", f"""regexp_replace(regexp_replace(translate(text, '{fixed.DEVANAGARI}', '0123456789'), {literal(UNICODE + r"(\d+)O([a-zA-Z]+)")}, '$10$2'), {literal(UNICODE + r"(?<=\s)\|(\d{3,4}(?:\.\d{2})?)")}, '1$1')"""),
        ("label_unit", "unit STRING", "STRING", f"coalesce({cases(fixed.LABEL_UNITS, 'lower(unit)')}, lower(unit))"),
        ("label_quantity_of", "raw STRING, g ARRAY<STRING>", "STRUCT<value DOUBLE, unit STRING, raw STRING>",
         "named_struct('value', coalesce(try_cast(g[0] AS DOUBLE), try_cast(g[2] AS DOUBLE) * try_cast(g[3] AS DOUBLE), try_cast(g[5] AS DOUBLE), try_cast(g[7] AS DOUBLE)), 'unit', label_unit(coalesce(g[1], g[4], g[6], g[8])), 'raw', raw)"),
        ("label_quantity_in", "raw STRING", "STRUCT<value DOUBLE, unit STRING, raw STRING>", f"label_quantity_of(raw, array({parts}))"),
        ("label_quantity", "text STRING", "STRUCT<value DOUBLE, unit STRING, raw STRING>", f"label_quantity_in({hit('text', fixed.NET_QUANTITY)})"),
        ("label_price", "text STRING", "DOUBLE",
         f"""coalesce(try_cast(replace(coalesce({hit('text', fixed.MRP, 1)}, {hit('text', fixed.MRP, 2)}), ',', '.') AS DOUBLE),
         array_max(filter(transform(regexp_extract_all(text, {regex(fixed.DECIMAL_PRICE, False)}, 1), x -> try_cast(x AS DOUBLE)), x -> x BETWEEN 10 AND 99999)))"""),
        ("label_licence", "text STRING", "STRING",
         f"coalesce({hit('text', fixed.LICENCE, 1)}, CASE WHEN locate('FSSAI', upper(text)) > 0 THEN {hit('''substring(text, greatest(locate('FSSAI', upper(text)) - 21, 0) + 1, locate('FSSAI', upper(text)) + 59 - greatest(locate('FSSAI', upper(text)) - 21, 0))''', fixed.LICENCE_ALONE, 1, False)} END)"),
        ("label_dates_of", "made STRING, after STRING, words ARRAY<STRING>, lasts BOOLEAN", "STRUCT<made STRING, expires STRING, best_before STRING>",
         "named_struct('made', coalesce(made, get(words, 0)), 'expires', coalesce(CASE WHEN NOT lasts THEN after END, CASE WHEN get(words, 1) <> coalesce(made, get(words, 0), '') THEN get(words, 1) END), 'best_before', CASE WHEN lasts THEN after END)"),
        ("label_dates_by", "made STRING, after STRING, words ARRAY<STRING>", "STRUCT<made STRING, expires STRING, best_before STRING>", f"label_dates_of(made, after, words, coalesce(after RLIKE {literal(ANY_CASE + fixed.DURATION)}, false))"),
        ("label_dates", "text STRING", "STRUCT<made STRING, expires STRING, best_before STRING>",
         f"label_dates_by({TRIM.format(hit('text', fixed.MADE_ON, 1))}, {TRIM.format(hit('text', fixed.EXPIRES_ON, 1))}, regexp_extract_all(text, {regex(fixed.ANY_DATE)}, 1))"),
        ("label_contact_in", "text STRING, near STRING", "STRUCT<phone STRING, email STRING>",
         f"named_struct('phone', {TRIM.format('coalesce(' + hit('near', fixed.PHONE, 0, False) + ', ' + hit('text', fixed.PHONE, 0, False) + ')')}, 'email', {TRIM.format('coalesce(' + hit('near', fixed.EMAIL) + ', ' + hit('text', fixed.EMAIL) + ')')})"),
        ("label_contact", "text STRING", "STRUCT<phone STRING, email STRING>", f"label_contact_in(text, CASE WHEN regexp_instr(text, {regex(fixed.CARE)}) > 0 THEN substring(text, regexp_instr(text, {regex(fixed.CARE)}), 200) END)"),
        ("has_hindi", "text STRING", "BOOLEAN", "coalesce(text RLIKE '[ऀ-ॿ]', false)"),
        ("has_english", "text STRING", "BOOLEAN", "coalesce(text RLIKE '[A-Za-z]', false)"),
    ]


#: Table functions: ``name, parameters, columns, query``.
TABLE_FUNCTIONS = [
    ("label_lines", "text STRING", "line_no INT, line STRING", f"SELECT pos + 1, {TRIM.format('line')} FROM (SELECT posexplode(split(text, '\\n')) AS (pos, line)) WHERE {TRIM.format('line')} <> ''"),
    ("rule_rows", "results ARRAY<STRUCT<rule_no INT, rule_id STRING, status STRING, severity STRING, weight DOUBLE>>", "rule_no INT, rule_id STRING, status STRING, severity STRING, weight DOUBLE", "SELECT inline(results)"),
]


def register_functions(spark: SparkSession) -> None:
    for name, parameters, kind, body in functions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views ``packages, label_texts, codes, blocks, scans`` and ``audits`` (results and score by package), and all functions."""
    held = tables.packages(spark, sf_dir)
    held.createOrReplaceTempView("packages")
    tables.label_texts(spark, sf_dir).createOrReplaceTempView("label_texts")
    tables.lines(spark, sf_dir).createOrReplaceTempView("blocks")
    held.where("barcode_value IS NOT NULL").selectExpr("package_id", "barcode_value AS code").createOrReplaceTempView("codes")
    audited = rules.with_results(held)
    audited.select("package_id", "analysis_source", "results", scoring.rule_score(audited["results"]).alias("rule_score"), packages.weak_label(audited["results"]).alias("weak_label")).createOrReplaceTempView("audits")
    register_functions(spark)
