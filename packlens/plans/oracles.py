"""DuckDB SQL for the registered queries that SQL can express.

The statements are written against the test tables on their own: they share only
fixed values with the Spark code.
"""

from __future__ import annotations

import re

from ..functions import fixed
from ..operators.rule_texts import ABSENT, NAMES


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def check(body: str) -> str:
    """The mod-10 check digit of a body of digits."""
    return f"((10 - list_sum(list_transform(range(1, length({body}) + 1), lambda i: CAST(substr(reverse({body}), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10)"


def code_of(k: str) -> str:
    """The code of a part, as the adapters make it."""
    body = f"('890' || lpad({k}::VARCHAR, 9, '0'))"
    two, short, long, eight = f"('2' || lpad({k}::VARCHAR, 11, '0'))", f"lpad({k}::VARCHAR, 11, '0')", f"('1' || {body})", f"lpad({k}::VARCHAR, 7, '3')"
    wrong = f"(({check(body)} + 1) % 10)"
    return (
        f"CASE {k} % 13 WHEN 0 THEN NULL WHEN 1 THEN {body} || {wrong}::VARCHAR WHEN 2 THEN {two} || {check(two)}::VARCHAR WHEN 3 THEN {short} || {check(short)}::VARCHAR "
        f"WHEN 4 THEN {long} || {check(long)}::VARCHAR WHEN 5 THEN {eight} || {check(eight)}::VARCHAR WHEN 6 THEN {eight} ELSE {body} || {check(body)}::VARCHAR END"
    )


ECONOMIES = f"economies(low, high, economy) AS (VALUES {values(fixed.PREFIX_ECONOMIES)})"
RESERVED = f"reserved(no, low, high, reason) AS (VALUES {values([(i, *r) for i, r in enumerate(fixed.RESERVED_PREFIXES)])})"
LENGTHS = "CASE length(digits) WHEN 8 THEN 'GTIN-8' WHEN 12 THEN 'UPC-A (GTIN-12)' WHEN 13 THEN 'EAN-13 (GTIN-13)' WHEN 14 THEN 'GTIN-14 / ITF-14' END"
BODY = "substr(digits, 1, length(digits) - 1)"
FACTS = f"""
{ECONOMIES}, {RESERVED},
facts1 AS (SELECT package_id, regexp_replace(code, '[^0-9]', '', 'g') AS digits FROM codes),
facts2 AS (SELECT *, {LENGTHS} AS format FROM facts1),
facts3 AS (SELECT *, CASE WHEN format IS NOT NULL THEN {check(BODY)} = CAST(substr(digits, length(digits), 1) AS INTEGER) ELSE false END AS checksum_valid,
  CASE WHEN format IS NOT NULL THEN lpad(digits, 14, '0') END AS gtin14 FROM facts2),
facts4 AS (SELECT *, CASE WHEN length(digits) <> 8 THEN substr(gtin14, 2, 3) END AS prefix FROM facts3),
facts AS (SELECT f.*, e.economy AS country,
  (SELECT arg_min(r.reason, r.no) FROM reserved r WHERE CAST(f.prefix AS INTEGER) BETWEEN r.low AND r.high) AS restricted_reason
  FROM facts4 f LEFT JOIN economies e ON CAST(f.prefix AS INTEGER) BETWEEN e.low AND e.high)"""

PACKAGES = f"""
first AS (SELECT l_partkey, min(l_suppkey) AS suppkey, min(l_shipdate) AS shipdate FROM lineitem GROUP BY 1),
raw AS (
  SELECT p.*, p_partkey AS k, s_name, n_name, r_name, shipdate, {code_of("p_partkey")} AS barcode_value
  FROM part p LEFT JOIN first ON p_partkey = l_partkey LEFT JOIN supplier ON suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
codes AS (SELECT k AS package_id, barcode_value AS code FROM raw WHERE barcode_value IS NOT NULL),
{FACTS},
based AS (
  SELECT k AS package_id, k, CASE WHEN k % 3 = 0 THEN 'barcode_registry' ELSE 'image' END AS analysis_source,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE p_name END AS commodity_name,
    CASE WHEN k % 4 <> 0 THEN s_name END AS manufacturer_name,
    CASE WHEN k % 10 = 3 THEN NULL WHEN k % 17 = 0 THEN 'Short' ELSE s_name || ', ' || n_name || ', ' || r_name END AS manufacturer_address,
    CASE WHEN k % 5 = 0 THEN 'Packer ' || k END AS packer_name, CASE WHEN k % 10 = 0 THEN 'Plot ' || k || ', Sector 9' END AS packer_address,
    CASE WHEN k % 7 = 0 THEN 'Importer ' || k END AS importer_name, CASE WHEN k % 14 = 0 THEN 'Dock ' || k || ', Port Road' END AS importer_address,
    CASE WHEN k % 5 = 0 THEN 'India' WHEN k % 5 IN (1, 2) THEN n_name END AS country_of_origin,
    CASE WHEN k % 19 <> 0 THEN p_size * CAST(10.0 AS DOUBLE) END AS net_quantity_value,
    CASE WHEN k % 17 <> 0 THEN CASE p_type WHEN 'STANDARD' THEN 'g' WHEN 'SMALL' THEN 'ml' WHEN 'MEDIUM' THEN 'kg' WHEN 'LARGE' THEN 'l' WHEN 'ECONOMY' THEN 'U' ELSE 'cl' END END AS net_quantity_unit,
    CASE WHEN k % 23 <> 0 THEN CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'weight' WHEN p_type IN ('SMALL', 'LARGE') THEN 'volume' ELSE 'number' END END AS net_quantity_category,
    CASE WHEN k % 23 <> 0 THEN p_retailprice END AS mrp_value, CASE WHEN k % 8 <= 1 THEN true WHEN k % 8 <= 3 THEN false END AS mrp_includes_tax, k % 29 = 0 AS mrp_altered,
    CASE WHEN k % 11 <> 0 THEN strftime(shipdate, '%Y-%m-%d') END AS manufacture_date, CAST(NULL AS VARCHAR) AS expiry_date, CASE WHEN k % 33 = 0 THEN '12 months' END AS best_before,
    CASE WHEN k % 13 <> 0 THEN '1800 123 4567' END AS consumer_care_phone, CASE WHEN k % 26 = 0 THEN 'care@pack.example' END AS consumer_care_email,
    CASE WHEN k % 9 = 0 THEN lpad(k::VARCHAR, 14, '1') END AS fssai_license_number, k % 18 = 1 AS has_fssai_logo, k % 6 = 2 AS has_veg_nonveg_symbol,
    k % 7 <> 0 AS has_english_text, false AS has_hindi_text, CAST((k % 11) / 10.0 AS DOUBLE) AS average_ocr_confidence, CAST(k % 20 AS INTEGER) AS total_text_blocks,
    CASE WHEN k % 4 <> 1 THEN CAST(k % 7 AS DOUBLE) END AS mrp_contrast_ratio, CASE WHEN k % 3 <> 1 THEN CAST(k % 9 AS DOUBLE) END AS net_qty_contrast_ratio,
    CASE WHEN k % 10 <> 0 THEN CAST((k % 9) * 0.5 AS DOUBLE) END AS price_height, CASE WHEN k % 10 <> 0 THEN CAST((k % 8) * 0.5 AS DOUBLE) END AS quantity_height, CASE WHEN k % 12 <> 0 THEN CAST((k % 5) * 0.5 AS DOUBLE) END AS min_height,
    CASE WHEN k % 16 <> 3 THEN CAST(k % 6 AS DOUBLE) END AS above, CASE WHEN k % 16 <> 3 THEN CAST((k + 1) % 6 AS DOUBLE) END AS below,
    CASE WHEN k % 16 <> 3 THEN CAST((k + 2) % 6 AS DOUBLE) END AS "left", CASE WHEN k % 16 <> 3 THEN CAST((k + 3) % 6 AS DOUBLE) END AS "right",
    CAST(p_size * 1000.0 * CASE WHEN k % 31 = 0 THEN 100 ELSE 1 END AS DOUBLE) AS panel_area, k % 5 <> 0 AS on_panel,
    CASE WHEN k % 37 = 0 THEN 'wholesale' ELSE 'retail' END AS package_type, barcode_value, barcode_value IS NOT NULL AS has_barcode,
    k % 2 = 0 AS product_identified, p_brand AS barcode_registered_owner FROM raw),
packages AS (
  SELECT b.*, coalesce(importer_name, '') <> '' OR coalesce(importer_address, '') <> '' OR coalesce(country_of_origin, '') NOT IN ('', 'India') AS is_imported,
    f.format AS barcode_gtin_format, f.checksum_valid AS barcode_checksum_valid, f.country AS barcode_country,
    CASE WHEN has_barcode THEN coalesce(f.prefix = '890', false) END AS barcode_is_gs1_india, CASE WHEN has_barcode THEN f.restricted_reason IS NOT NULL END AS barcode_is_restricted
  FROM based b LEFT JOIN facts f USING (package_id))"""

REG = "(analysis_source = 'barcode_registry')"
MISSING = f"CASE WHEN {REG} THEN 'INCONCLUSIVE' ELSE 'FAIL' END"


def has(column: str) -> str:
    return f"coalesce({column} <> '', false)"


#: rule -> SQL for 'status|severity|weight'
def outcome(*cases: tuple[str, str], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {last} END"


def say(status: str, severity: str, weight: float) -> str:
    return f"'{status}|{severity}|{weight}'"


def missing(severity: str, weight: float) -> str:
    return f"{MISSING} || '|{severity}|{weight}'"


UNSEEN = (REG, say("NOT_APPLICABLE", "MAJOR", 0.0))
RATIO = "coalesce(nullif(mrp_contrast_ratio, 0), net_qty_contrast_ratio)"
LEAST = "CASE WHEN coalesce(panel_area, 0) = 0 THEN 1.0 WHEN panel_area <= 5000 THEN 1.0 WHEN panel_area <= 10000 THEN 1.5 WHEN panel_area <= 50000 THEN 2.5 WHEN panel_area <= 250000 THEN 4.0 ELSE 6.0 END"
ADDRESS = "CASE WHEN coalesce(manufacturer_address, '') <> '' THEN manufacturer_address WHEN coalesce(packer_address, '') <> '' THEN packer_address ELSE importer_address END"
APART = "lower(barcode_country) NOT LIKE '%' || lower(trim(country_of_origin)) || '%' AND lower(trim(country_of_origin)) NOT LIKE '%' || lower(barcode_country) || '%'"
RULE_SQL = {
    "R03_SCOPE": outcome(("package_type = 'wholesale'", say("NOT_APPLICABLE", "MINOR", 0.0)), ("net_quantity_value > 25 AND lower(coalesce(net_quantity_unit, '')) IN ('kg', 'l', 'litre', 'liter')", say("FAIL", "MAJOR", 0.5)), last=say("PASS", "MINOR", 0.25)),
    "R26_EXEMPTION": say("NOT_APPLICABLE", "MINOR", 0.0),
    "R05_STD_QTY": say("INCONCLUSIVE", "MAJOR", 0.5),
    "R06_NAME": outcome((has("commodity_name"), say("PASS", "CRITICAL", 1.0)), last=missing("CRITICAL", 1.0)),
    "R10_MFR_NAME": outcome((f"{has('manufacturer_name')} OR {has('packer_name')} OR {has('importer_name')}", say("PASS", "CRITICAL", 1.0)), last=missing("CRITICAL", 1.0)),
    "R10_ADDRESS": outcome((f"length(trim({ADDRESS})) > 10", say("PASS", "CRITICAL", 1.0)), last=missing("CRITICAL", 1.0)),
    "R11_NET_QTY": outcome(("net_quantity_value IS NOT NULL", say("PASS", "CRITICAL", 1.0)), last=missing("CRITICAL", 1.0)),
    "R13_UNITS": outcome((f"{has('net_quantity_unit')} AND {has('net_quantity_category')}", say("PASS", "MAJOR", 0.5)), (has("net_quantity_unit"), say("WARNING", "MAJOR", 0.5)), last=missing("MAJOR", 0.5)),
    "R12_QTY_FMT": outcome((f"net_quantity_value IS NOT NULL AND {has('net_quantity_unit')}", say("PASS", "MAJOR", 0.5)), last=say("INCONCLUSIVE", "MAJOR", 0.5)),
    "R06_MRP": outcome(("mrp_value IS NOT NULL", say("PASS", "CRITICAL", 1.0)), last=missing("CRITICAL", 1.0)),
    "R06_MRP_TAX": outcome(("mrp_value IS NULL", say("INCONCLUSIVE", "MAJOR", 0.5)), ("mrp_includes_tax", say("PASS", "MAJOR", 0.5)), (f"{REG} OR mrp_includes_tax IS NULL", say("INCONCLUSIVE", "MAJOR", 0.5)), last=say("FAIL", "MAJOR", 0.5)),
    "R06_COO": outcome((has("country_of_origin"), say("PASS", "MAJOR", 0.5)), ("is_imported", say("FAIL", "MAJOR", 0.5)), last=say("NOT_APPLICABLE", "MINOR", 0.0)),
    "R18_MRP_ALTER": outcome(UNSEEN, ("mrp_altered", say("FAIL", "CRITICAL", 1.0)), last=say("PASS", "CRITICAL", 1.0)),
    "R06_DATE": outcome((f"{has('manufacture_date')} OR {has('best_before')}", say("PASS", "MAJOR", 0.5)), last=missing("MAJOR", 0.5)),
    "R06_CONSUMER": outcome((f"{has('consumer_care_phone')} OR {has('consumer_care_email')}", say("PASS", "MAJOR", 0.5)), last=missing("MAJOR", 0.5)),
    "R09_LEGIBLE": outcome(UNSEEN, ("average_ocr_confidence = 0", say("INCONCLUSIVE", "MAJOR", 0.5)), ("average_ocr_confidence >= 0.4", say("PASS", "MAJOR", 0.5)), last=say("FAIL", "MAJOR", 0.5)),
    "R09_CONTRAST": outcome(UNSEEN, (f"{RATIO} IS NULL", say("INCONCLUSIVE", "MAJOR", 0.5)), (f"{RATIO} >= 3", say("PASS", "MAJOR", 0.5)), last=say("FAIL", "MAJOR", 0.5)),
    "R08_PDP": outcome(UNSEEN, ("on_panel", say("PASS", "MAJOR", 0.5)), last=say("WARNING", "MAJOR", 0.5)),
    "R08_CLEAR": outcome(UNSEEN, ('above IS NULL OR below IS NULL OR "left" IS NULL OR "right" IS NULL OR quantity_height IS NULL', say("INCONCLUSIVE", "MINOR", 0.25)),
                         ('least(above, below) >= quantity_height AND least("left", "right") >= 2 * quantity_height', say("PASS", "MINOR", 0.25)), last=say("FAIL", "MINOR", 0.25)),
    "R07_FONT": outcome(UNSEEN, ("price_height IS NULL AND quantity_height IS NULL", say("INCONCLUSIVE", "MAJOR", 0.5)), (f"least(price_height, quantity_height) < {LEAST}", say("FAIL", "MAJOR", 0.5)), last=say("PASS", "MAJOR", 0.5)),
    "R09_LIQUID": say("NOT_APPLICABLE", "MINOR", 0.0), "R09_WRAPPER": say("NOT_APPLICABLE", "MINOR", 0.0),
    "R09_LANG": outcome(UNSEEN, ("has_hindi_text OR has_english_text", say("PASS", "MAJOR", 0.5)), last=say("FAIL", "MAJOR", 0.5)),
    "R23_DECEPTIVE": say("INCONCLUSIVE", "CRITICAL", 0.0), "R22_MPE": say("NOT_APPLICABLE", "MAJOR", 0.0), "R19_STAT_AVG": say("NOT_APPLICABLE", "MAJOR", 0.0),
    "R19_IND_MPE": say("NOT_APPLICABLE", "MAJOR", 0.0), "R19_SAMPLE": say("NOT_APPLICABLE", "MAJOR", 0.0),
    "R24_WHOLESALE": outcome(("package_type <> 'wholesale'", say("NOT_APPLICABLE", "MAJOR", 0.0)), (f"({has('manufacturer_name')} OR {has('importer_name')}) AND net_quantity_value IS NOT NULL", say("PASS", "MAJOR", 0.5)), last=say("FAIL", "MAJOR", 0.5)),
    "R25_EXPORT": outcome(("NOT is_imported", say("NOT_APPLICABLE", "CRITICAL", 0.0)), (f"{has('importer_name')} AND {has('importer_address')}", say("PASS", "CRITICAL", 1.0)), last=say("FAIL", "CRITICAL", 1.0)),
    "R27_REG": say("INCONCLUSIVE", "MINOR", 0.0), "R31_AD": say("NOT_APPLICABLE", "MINOR", 0.0),
    "B01_GTIN_STRUCT": outcome(("NOT has_barcode", say("NOT_APPLICABLE", "MINOR", 0.0)), (has("barcode_gtin_format"), say("PASS", "MINOR", 0.25)), last=say("FAIL", "MAJOR", 0.5)),
    "B02_GTIN_CHECKSUM": outcome(("barcode_checksum_valid IS NULL", say("INCONCLUSIVE", "MINOR", 0.25)), ("barcode_checksum_valid", say("PASS", "MINOR", 0.25)), last=say("FAIL", "MAJOR", 0.5)),
    "B03_GTIN_SCOPE": outcome(("NOT has_barcode", say("NOT_APPLICABLE", "MINOR", 0.0)), ("barcode_is_restricted", say("FAIL", "MAJOR", 0.5)), last=say("PASS", "MINOR", 0.25)),
    "B04_GS1_AUTHORITY": outcome(("barcode_country IS NULL", say("WARNING", "MINOR", 0.25)), last=say("PASS", "MINOR", 0.25)),
    "B05_REGISTRY_ID": outcome(("product_identified", say("PASS", "MAJOR", 0.5)), last=say("WARNING", "MAJOR", 0.5)),
    "B06_ORIGIN_CONSISTENCY": outcome(("coalesce(trim(country_of_origin), '') = ''", say("NOT_APPLICABLE", "MINOR", 0.0)), (f"barcode_country IS NOT NULL AND {APART}", say("WARNING", "MINOR", 0.25)), last=say("PASS", "MINOR", 0.25)),
}
ALL_RULES = " UNION ALL ".join(f"SELECT package_id, {i} AS rule_no, '{r}' AS rule_id, {sql} AS o FROM packages" + (f" WHERE has_barcode OR {REG}" if r.startswith("B") else "") for i, (r, sql) in enumerate(RULE_SQL.items(), 1))
RESULTS = f"""{PACKAGES},
outcomes AS ({ALL_RULES}),
results AS (SELECT package_id, rule_no, rule_id, split_part(o, '|', 1) AS status, split_part(o, '|', 2) AS severity, CAST(split_part(o, '|', 3) AS DOUBLE) AS weight FROM outcomes),
names(rule_id, rule_name) AS (VALUES {values(list(NAMES.items()))}),
sums AS (SELECT package_id, sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END) AS passed_w, sum(CASE WHEN status IN ('PASS', 'FAIL', 'WARNING') THEN weight ELSE 0 END) AS judged_w,
  sum(CASE WHEN status = 'INCONCLUSIVE' AND severity <> 'MINOR' THEN weight ELSE 0 END) AS open_w, count(*) FILTER (status = 'INCONCLUSIVE' AND severity <> 'MINOR') AS open_n,
  count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'WARNING') AS warned, count(*) FILTER (status = 'NOT_APPLICABLE') AS none_n, count(*) FILTER (status = 'INCONCLUSIVE') AS inc_n,
  count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') AS crit, count(*) FILTER (status = 'FAIL' AND severity = 'MAJOR') AS maj, count(*) FILTER (status = 'FAIL' AND severity = 'MINOR') AS minor,
  count(*) AS total FROM results GROUP BY 1)"""
STARS = "CASE WHEN {0} >= 0.95 THEN 5 WHEN {0} >= 0.8 THEN 4 WHEN {0} >= 0.6 THEN 3 WHEN {0} >= 0.4 THEN 2 ELSE 1 END"
STAR_LABELS = "CASE WHEN {0} >= 0.95 THEN 'Fully Compliant' WHEN {0} >= 0.8 THEN 'Mostly Compliant' WHEN {0} >= 0.6 THEN 'Partially Compliant' WHEN {0} >= 0.4 THEN 'Largely Non-Compliant' ELSE 'Critically Non-Compliant' END"
OPEN_SCORE = "CASE WHEN judged_w + open_w > 0 THEN passed_w / (judged_w + open_w) ELSE 1.0 END"



def drawn(name: str) -> str:
    """The number that a synthetic row draws by a name."""
    return f"(('0x' || substr(md5('42:{name}:' || p_partkey), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def known(feature: str) -> str:
    low, high = fixed.SYNTHETIC_RANGES[feature]
    return f"CASE WHEN {drawn(feature + ' known')} >= 0.1 THEN {ranged(feature)} END"


def ranged(feature: str) -> str:
    low, high = fixed.SYNTHETIC_RANGES[feature]
    return f"({low}::DOUBLE + {high - low}::DOUBLE * {drawn(feature)})"


MADE = f"""
bits AS (SELECT p_partkey, {", ".join(f"CAST({drawn(b)} < 0.7 AS INTEGER) AS {b}" for b in [*fixed.PRESENCE_FEATURES, "is_imported"])}, {drawn("language")} AS language,
  {ranged("mrp_font_height_mm")} AS price_mm, {ranged("net_qty_font_height_mm")} AS quantity_mm, {known("mrp_font_height_mm")} AS mrp_font_height_mm, {known("net_qty_font_height_mm")} AS net_qty_font_height_mm, {known("mrp_contrast_ratio")} AS mrp_contrast_ratio,
  {ranged("panel_area_mm2")} AS panel_area_mm2, {ranged("mrp_value")} AS mrp_value, row_number() OVER (ORDER BY md5('42:flip:' || p_partkey), p_partkey) <= floor(count(*) OVER () * 0.1) AS flip FROM part),
spoken AS (SELECT * REPLACE (CASE WHEN has_hindi = 0 AND has_english = 0 THEN CAST(language < 0.9 AS INTEGER) ELSE has_english END AS has_english), least(price_mm, quantity_mm) AS min_font_height_mm,
  2 + {" + ".join(fixed.PRESENCE_FEATURES[:10])} AS num_declarations_found FROM bits),
ruled AS (SELECT *, CAST(has_commodity_name = 1 AND has_manufacturer_name = 1 AND has_manufacturer_address = 1 AND has_net_quantity = 1 AND has_mrp = 1 AND has_mfg_date = 1 AND (has_consumer_care_phone = 1 OR has_consumer_care_email = 1)
  AND (has_hindi = 1 OR has_english = 1) AND coalesce(mrp_font_height_mm >= 1 AND net_qty_font_height_mm >= 1, false) AS INTEGER) AS by_rule FROM spoken),
made AS (SELECT *, CASE WHEN flip THEN 1 - by_rule ELSE by_rule END AS label FROM ruled)"""

WORDS = r"""
lines0 AS (SELECT doc_id AS image_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
words0 AS (SELECT image_id, line, unnest(string_split(content, ' ')) AS text, generate_subscripts(string_split(content, ' '), 1) - 1 AS w FROM lines0),
words AS (SELECT image_id, CAST(image_id % 3 AS INTEGER) AS page_num, CAST(line // 4 AS INTEGER) AS block_num, CAST(line % 2 AS INTEGER) AS par_num, CAST(line AS INTEGER) AS line_num, w, text,
  w * 50.0 AS l, line * 20.0 + w % 3 AS t, length(text) * 6.0 AS wd, 10.0 + w % 4 AS h, CAST((image_id * 7 + w * 13 + line) % 101 AS DOUBLE) AS conf FROM words0)"""
BLOCKS = r"""
lines0 AS (SELECT doc_id AS image_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block_no FROM documents),
lines1 AS (SELECT image_id, block_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, CAST((image_id + block_no) % 10 / 10.0 AS DOUBLE) AS confidence, CAST(image_id % 7 AS DOUBLE) AS lft, CAST(block_no * 20.0 AS DOUBLE) AS top,
  CAST(length(text) * 6.0 AS DOUBLE) AS wide, CAST(10.0 + (image_id + block_no * 3) % 9 AS DOUBLE) AS tall FROM lines0),
blocks0 AS (SELECT *, greatest(tall + 2, tall - 1) AS height_px, greatest(sqrt(wide * wide + 1), sqrt(wide * wide + 4)) AS width_px, (lft + lft + wide + lft + wide + lft) / 4 AS cx, (top + (top + 1) + (top + tall) + (top + tall + 2)) / 4 AS cy
  FROM lines1 WHERE text <> '' AND confidence >= 0.2),
blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY cy, cx, block_no) AS INTEGER) AS reading_no FROM blocks0)"""
BOXES = """
boxes0 AS (SELECT l_orderkey AS image_id, l_linenumber AS box_no, struct_pack(a := l_partkey, b := l_suppkey, c := l_extendedprice) AS o, l_quantity AS q, l_discount AS d FROM lineitem),
boxes AS (SELECT image_id, box_no, arg_min(q, o) AS x1, CAST(box_no * 10.0 AS DOUBLE) AS y1, arg_min(q, o) + 20 AS x2, CAST(box_no * 10.0 + 8 + box_no % 3 * 6 AS DOUBLE) AS y2, 1 - arg_min(d, o) AS confidence FROM boxes0 GROUP BY 1, 2)"""


def shared_area(a: str, b: str) -> str:
    return f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"


def iou(a: str, b: str, floor: bool) -> str:
    both = shared_area(a, b)
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {both})"
    return f"({both} / {f'greatest({union}, 1e-6)' if floor else f'({union} + 1e-6)'})"


def greedy(boxes: str, limit: float, same: str, floor: bool) -> str:
    return f"list_reduce(list_transform({boxes}, lambda e: [e]), lambda kept, e: CASE WHEN len(list_filter(kept, lambda o: {iou('o', 'e[1]', floor)} > {limit}{same})) > 0 THEN kept ELSE list_concat(kept, e) END)"


SYMBOLS = f"""{BOXES},
symbols AS (SELECT image_id, box_no AS symbol_no, ['fssai_logo', 'veg_symbol', 'nonveg_symbol', 'isi_mark', 'recycling_symbol', 'barcode', 'qr_code'][(image_id + box_no // 3) % 7 + 1] AS class_name,
  round(confidence - 0.4, 2) AS confidence, x1, y1, x2, y2, CASE WHEN box_no % 2 = 0 THEN 0 ELSE 1 END AS late FROM boxes)"""


def shows(*names: str) -> str:
    return f"coalesce(bool_or(class_name IN ({', '.join(map(quoted, names))}) AND confidence > 0.5), false)"


LABELS = r"""
labels AS (SELECT p_partkey AS image_id, concat_ws(chr(10), p_name,
  CASE p_partkey % 6 WHEN 0 THEN 'Net Wt ' || p_size || ' g' WHEN 1 THEN '3x' || p_size || ' Tablets' WHEN 2 THEN 'NET QTY: ' || p_size || '.5 ml' WHEN 3 THEN p_size || 'Og' WHEN 4 THEN p_size || ' capsules' ELSE '' END,
  CASE p_partkey % 4 WHEN 0 THEN 'MRP Rs ' || printf('%.2f', p_retailprice) || ' incl. of all taxes' WHEN 1 THEN 'M.R.P ₹' || printf('%.2f', p_retailprice) WHEN 2 THEN 'Price ' || printf('%.2f', p_retailprice) ELSE '' END,
  CASE p_partkey % 5 WHEN 0 THEN 'PKD 05/2024' || chr(10) || 'Best Before 12 months' WHEN 1 THEN 'MFD: 02-MAR-2025 EXP: 01-SEP-2026' WHEN 2 THEN '05/26 and 10/27' WHEN 3 THEN '02-MAR-2025' ELSE '' END,
  CASE p_partkey % 3 WHEN 0 THEN 'Mfd by: Maker ' || p_partkey || chr(10) || '12 Mill Road' || chr(10) || 'Pune 411001' || chr(10) || 'Net' WHEN 1 THEN 'Packed by Packer ' || p_partkey || chr(10) || 'Mktd by Seller ' || p_partkey || ', Agra' ELSE 'Imported by Trader ' || p_partkey || chr(10) || 'Dock 4' || chr(10) || 'MRP' END,
  CASE p_partkey % 7 WHEN 0 THEN 'Customer Care: 1800 123 4567 help@pack.example' WHEN 1 THEN 'call 9876543210' WHEN 2 THEN 'मूल्य FSSAI Lic No. 12345678901234' WHEN 3 THEN 'FSSAI xx 10012345678901 end' ELSE 'info@shop.example' END) AS raw, p_partkey AS k FROM part),
texts AS (SELECT image_id, k, regexp_replace(regexp_replace(translate(raw, '०१२३४५६७८९', '0123456789'), '([0-9]+)O([a-zA-Z]+)', '\10\2', 'g'), '(\s)\|(\d{3,4}(?:\.\d{2})?)', '\11\2', 'g') AS text FROM labels)"""


def hit(text: str, regex: str, group: int = 0, flags: str = "i") -> str:
    return f"nullif(regexp_extract({text}, {quoted(regex)}, {group}{f', {quoted(flags)}' if flags else ''}), '')"


#: The price pattern without what a number must not be followed by, which this dialect can't say and no label here has.
PRICED = re.sub(r"\(\?!.*?\)\)", "", fixed.MRP)


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


UNIT_CASE = "CASE lower({0}) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.LABEL_UNITS.items()) + " ELSE lower({0}) END"
def first_line(block: str) -> str:
    return f"list_filter(list_transform(string_split({block}, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')"


def party_block(role: str) -> str:
    after = f"regexp_extract(text, {quoted('(?is)' + fixed.PARTY[role] + '(.*)')}, 1)"
    return trimmed(f"regexp_extract(substr({after}, 1, 200), {quoted('(?is)^(.*?)(?:' + fixed.PARTY_END + r'|\z)')}, 1)")


def name_and_address(role: str) -> str:
    lines = first_line(party_block(role))
    return f"{lines}[1] AS {role}_name, CASE WHEN len({lines}) > 1 THEN array_to_string({lines}[2:], ', ') END AS {role}_address"


DIGITS_NEAR = "substr(text, greatest(strpos(upper(text), 'FSSAI') - 21, 0) + 1, strpos(upper(text), 'FSSAI') - 1 + 60 - greatest(strpos(upper(text), 'FSSAI') - 21, 0))"
RECORDS = """
base AS (SELECT lpad(p_partkey::VARCHAR, 13, '0') AS gtin, p_partkey AS k, * FROM part),
records AS (
  SELECT gtin, k, 'open_food_facts' AS source, 1 AS rank, CASE WHEN k % 4 <> 0 THEN p_name END AS product_name, p_brand AS brand, p_brand AS manufacturer_name, CASE WHEN k % 2 = 0 THEN 'South Africa, India' END AS country_of_origin,
    CASE k % 5 WHEN 0 THEN '30 g' WHEN 1 THEN '1,5 L' WHEN 2 THEN p_size || ' pcs' WHEN 3 THEN 'a box' END AS net_quantity_raw, CAST(CASE k % 5 WHEN 0 THEN 30 WHEN 1 THEN 1.5 WHEN 2 THEN p_size END AS DOUBLE) AS net_quantity_value, CASE k % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'l' WHEN 2 THEN 'U' END AS net_quantity_unit,
    CAST(CASE WHEN k % 9 = 0 THEN p_size + 0.5 END AS DOUBLE) AS mrp_value, CASE k % 3 WHEN 1 THEN 'NON_VEG' ELSE 'VEG' END AS veg_non_veg, 'salt, oil' AS ingredients, 'Snacks|Salty|Crisps' AS categories, 'http://i.example/a.png' AS image_urls FROM base WHERE k % 7 <> 0 AND k % 10 <> 9
  UNION ALL SELECT gtin, k, 'upcitemdb', 5, upper(p_name), CASE WHEN k % 3 = 0 THEN p_brand END, CASE WHEN k % 3 = 0 THEN p_brand END, NULL, p_size || ' oz', NULL, NULL, NULL, NULL, NULL, 'Food|Snacks|Crisps', 'http://i.example/b.png|http://i.example/a.png' FROM base WHERE k % 3 <> 1
  UNION ALL SELECT gtin, k, 'gs1_india_datakart', 0, CASE WHEN k % 2 = 0 THEN p_name END, NULL, 'Maker Ltd', 'India', p_size || ' kg', CAST(p_size AS DOUBLE), 'kg', CAST(CASE WHEN k % 4 = 0 THEN printf('%.1f', p_retailprice) END AS DOUBLE), CASE k % 6 WHEN 0 THEN 'VEG' WHEN 1 THEN 'NON_VEG' END, NULL, NULL, NULL FROM base WHERE k % 5 = 0),
merged AS (SELECT gtin, k, """ + ", ".join(f"arg_min({c}, rank) FILTER ({c} IS NOT NULL) AS {c}" for c in ("product_name", "brand", "manufacturer_name", "country_of_origin", "net_quantity_raw", "net_quantity_value", "net_quantity_unit", "mrp_value", "veg_non_veg")) + """,
  string_agg(source, '|' ORDER BY rank) AS sources, arg_min(source, rank) FILTER (product_name IS NOT NULL) AS from_name, arg_min(source, rank) FILTER (brand IS NOT NULL) AS from_brand, arg_min(source, rank) FILTER (mrp_value IS NOT NULL) AS from_mrp,
  bool_or(rank = 1) AS has_facts, bool_or(rank = 5) AS has_upc FROM records GROUP BY 1, 2)"""
LISTS = "CASE WHEN has_facts AND has_upc THEN 'Snacks|Salty|Crisps|Food' WHEN has_facts THEN 'Snacks|Salty|Crisps' WHEN has_upc THEN 'Food|Snacks|Crisps' ELSE '' END AS categories, CASE WHEN has_facts AND has_upc THEN 'http://i.example/a.png|http://i.example/b.png' WHEN has_facts THEN 'http://i.example/a.png' WHEN has_upc THEN 'http://i.example/b.png|http://i.example/a.png' ELSE '' END AS image_urls"

ORACLES: dict[str, str] = {
    "label_declarations": f"""WITH {LABELS}, q AS (SELECT image_id, text, {", ".join(f"{hit('text', fixed.NET_QUANTITY, i)} AS g{i}" for i in range(1, 10))}, strip_made, strip_exp, found FROM (SELECT *, {trimmed(hit('text', fixed.MADE_ON, 1))} AS strip_made, {trimmed(hit('text', fixed.EXPIRES_ON, 1))} AS strip_exp, regexp_extract_all(text, {quoted('(?i)' + fixed.ANY_DATE)}, 1) AS found FROM texts)),
      d AS (SELECT *, coalesce(strip_made, found[1]) AS made, coalesce(regexp_matches(strip_exp, {quoted('(?i)' + fixed.DURATION)}), false) AS lasts, regexp_extract(text, {quoted('(?is)(' + fixed.CARE + '.*)')}, 1) AS tail FROM q), r AS (SELECT *, CASE WHEN tail <> '' THEN substr(tail, 1, 200) ELSE text END AS region FROM d)
      SELECT image_id, coalesce(CAST(g1 AS DOUBLE), CAST(g3 AS DOUBLE) * CAST(g4 AS DOUBLE), CAST(g6 AS DOUBLE), CAST(g8 AS DOUBLE)) AS quantity, CASE WHEN coalesce(g1, g3, g6, g8) IS NOT NULL THEN {UNIT_CASE.format('coalesce(g2, g5, g7, g9)')} END AS unit,
      coalesce({hit('text', fixed.LICENCE, 1)}, CASE WHEN strpos(upper(text), 'FSSAI') > 0 THEN {hit(DIGITS_NEAR, fixed.LICENCE_ALONE, 1, '')} END) AS licence, made, coalesce(CASE WHEN NOT lasts THEN strip_exp END, CASE WHEN found[2] <> coalesce(made, '') THEN found[2] END) AS expires, CASE WHEN lasts THEN strip_exp END AS best_before,
      {trimmed(f"coalesce({hit('region', fixed.PHONE, 0, '')}, {hit('text', fixed.PHONE, 0, '')})")} AS phone, coalesce({hit('region', fixed.EMAIL)}, {hit('text', fixed.EMAIL)}) AS email, regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') AS hindi, regexp_matches(text, '[A-Za-z]') AS english FROM r""",
    "label_prices": f"""WITH {LABELS}, q AS (SELECT image_id, {hit('text', PRICED)} AS raw, coalesce({hit('text', PRICED, 1)}, {hit('text', PRICED, 2)}) AS digits, regexp_extract_all(text, {quoted(fixed.DECIMAL_PRICE)}, 1) AS found FROM texts),
      v AS (SELECT *, TRY_CAST(replace(digits, ',', '.') AS DOUBLE) AS value, list_max(list_filter(list_transform(found, lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 10 AND 99999)) AS best FROM q),
      w AS (SELECT image_id, coalesce(value, best) AS mrp, CASE WHEN value IS NOT NULL THEN raw WHEN best IS NOT NULL THEN printf('₹ %.2f', best) END AS raw FROM v)
      SELECT image_id, mrp, raw, coalesce(lower(raw) LIKE '%incl%' OR lower(raw) LIKE '%all tax%', false) AS tax FROM w""",
    "label_parties": f"""WITH {LABELS}, p AS (SELECT image_id, {name_and_address('manufacturer')}, {name_and_address('packer')}, {name_and_address('importer')}, {name_and_address('marketer')} FROM texts)
      SELECT image_id, coalesce(manufacturer_name, marketer_name) AS manufacturer_name, CASE WHEN manufacturer_name IS NOT NULL THEN manufacturer_address ELSE marketer_address END AS manufacturer_address, packer_name, packer_address, importer_name, importer_address FROM p""",
    "registry_records": f"WITH {RECORDS} SELECT gtin, source, product_name, brand, manufacturer_name, country_of_origin, net_quantity_raw, net_quantity_value, net_quantity_unit, mrp_value, veg_non_veg, ingredients, categories, image_urls FROM records",
    "registry_merge": f"WITH {RECORDS} SELECT gtin, product_name, brand, manufacturer_name, country_of_origin, net_quantity_raw, net_quantity_value, net_quantity_unit, mrp_value, veg_non_veg, sources, coalesce(product_name, brand, net_quantity_raw, manufacturer_name) IS NOT NULL AS found, from_name, from_brand, from_mrp, {LISTS} FROM merged",
    "registry_gap_fill": f"""WITH {RECORDS} SELECT m.gtin, CASE WHEN m.k % 2 = 1 THEN coalesce(m.product_name, 'Read ' || p_name) ELSE m.product_name END AS product_name, CASE WHEN m.k % 2 = 1 THEN coalesce(mrp_value, p_retailprice) ELSE mrp_value END AS mrp_value, manufacturer_name, sources || CASE WHEN m.k % 2 = 1 THEN '|gemini_llm' ELSE '' END AS sources,
      coalesce(from_name, CASE WHEN m.k % 2 = 1 THEN 'gemini_llm' END) AS from_name, coalesce(from_mrp, CASE WHEN m.k % 2 = 1 THEN 'gemini_llm' END) AS from_mrp FROM merged m JOIN part ON p_partkey = m.k""",
    "registry_packages": f"""WITH {RECORDS}, codes AS (SELECT gtin AS package_id, gtin AS code FROM merged), {FACTS}, u(raw, unit, category) AS (VALUES {values([(k, v, c) for c, t in fixed.PACKAGE_UNITS.items() for k, v in t.items()])})
      SELECT gtin, product_name AS commodity_name, net_quantity_value, coalesce(unit, net_quantity_unit) AS net_quantity_unit, CASE WHEN net_quantity_unit IS NOT NULL THEN coalesce(category, 'number') END AS net_quantity_category, coalesce(country_of_origin, 'India') <> 'India' AS is_imported, veg_non_veg IS NOT NULL AS has_veg_nonveg_symbol, format AS barcode_gtin_format, checksum_valid AS barcode_checksum_valid,
      coalesce(brand, manufacturer_name) AS barcode_registered_owner, coalesce(product_name, brand, net_quantity_raw, manufacturer_name) IS NOT NULL AS product_identified FROM merged JOIN facts ON package_id = gtin LEFT JOIN u ON raw = lower(net_quantity_unit)""",
    "attached_registry": f"""WITH {PACKAGES}, {RECORDS}, j AS (SELECT p.*, m.gtin, m.product_name, m.manufacturer_name AS mm, m.country_of_origin AS mc, m.net_quantity_value AS mq, m.net_quantity_unit AS mu FROM packages p LEFT JOIN merged m ON m.k = package_id)
      SELECT package_id, CASE WHEN {has('commodity_name')} THEN commodity_name ELSE coalesce(product_name, commodity_name) END AS commodity_name, coalesce(manufacturer_name, mm) AS manufacturer_name, coalesce(net_quantity_value, mq) AS net_quantity_value,
      concat_ws('|', CASE WHEN NOT {has('commodity_name')} AND product_name IS NOT NULL THEN 'commodity_name' END, CASE WHEN manufacturer_name IS NULL AND mm IS NOT NULL THEN 'manufacturer_name' END, CASE WHEN country_of_origin IS NULL AND mc IS NOT NULL THEN 'country_of_origin' END, CASE WHEN net_quantity_value IS NULL AND mq IS NOT NULL THEN 'net_quantity_value' END, CASE WHEN net_quantity_unit IS NULL AND mu IS NOT NULL THEN 'net_quantity_unit' END) AS filled, gtin IS NOT NULL AS product_identified FROM j""",
    "ocr_lines": f"""WITH {WORDS}, held AS (SELECT image_id, page_num, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY w) AS text, avg(conf) / 100 AS confidence, min(l) AS x1, min(t) AS y1, max(l + wd) AS x2, max(t + h) AS y2
      FROM words WHERE {trimmed('text')} <> '' AND conf > 0 GROUP BY ALL) SELECT image_id, page_num, block_num, par_num, line_num, text, round(confidence, 9) AS confidence, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM held WHERE confidence >= 0.2""",
    "ocr_confident_words": f"WITH {WORDS} SELECT image_id, count(*) AS words, sum(conf) AS conf FROM words WHERE conf > 20 GROUP BY 1",
    "ocr_blocks": f"""WITH {BLOCKS} SELECT image_id, block_no, text, reading_no, round(height_px, 6) AS height_px, round(width_px, 6) AS width_px, cx, cy, lft AS x1, top AS y1, lft + wide AS x2, top + tall + 2 AS y2, (lft + wide) / 2 AS sx, (top + tall) / 4 AS sy FROM blocks""",
    "ocr_full_text": f"WITH {BLOCKS} SELECT image_id, string_agg(text, chr(10) ORDER BY reading_no) AS text, round(avg(confidence), 9) AS average_confidence, CAST(count(*) AS INTEGER) AS total_blocks FROM blocks GROUP BY 1",
    "ocr_distinct_boxes": f"""WITH {BOXES}, lists AS (SELECT image_id, list(struct_pack(x1, y1, x2, y2, box_no, confidence) ORDER BY confidence DESC, box_no) AS l FROM boxes WHERE confidence >= 0.2 GROUP BY 1),
      kept AS (SELECT image_id, unnest({greedy('l', 0.4, '', False)}) AS k FROM lists) SELECT image_id, k.box_no AS box_no, round(k.confidence, 6) AS confidence FROM kept""",
    "symbol_dedup": f"""WITH {SYMBOLS}, lists AS (SELECT image_id, list(struct_pack(x1, y1, x2, y2, symbol_no, class_name, confidence) ORDER BY late, confidence DESC, symbol_no) AS l FROM symbols GROUP BY 1),
      kept AS (SELECT image_id, unnest({greedy('l', 0.3, ' AND o.class_name = e[1].class_name', True)}) AS k FROM lists) SELECT image_id, k.symbol_no AS symbol_no, k.class_name AS class_name, round(k.confidence, 6) AS confidence FROM kept""",
    "symbol_flags": f"""WITH {SYMBOLS} SELECT image_id, {shows('fssai_logo')} AS has_fssai_logo, {shows('veg_symbol', 'nonveg_symbol')} AS has_veg_nonveg_symbol, {shows('isi_mark')} AS has_isi_mark, {shows('recycling_symbol')} AS has_recycling_symbol, {shows('barcode', 'qr_code')} AS has_barcode FROM symbols GROUP BY 1""",
    "commodity_name": f"""WITH {BLOCKS}, half AS (SELECT *, cy < max(cy) OVER (PARTITION BY image_id) * 0.5 AS up FROM blocks), held AS (SELECT *, bool_or(up) OVER (PARTITION BY image_id) AS any_up FROM half),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY height_px DESC, reading_no) AS r FROM held WHERE up OR NOT any_up),
      fit AS (SELECT *, NOT regexp_matches(text, {quoted('(?i)' + fixed.NOT_A_NAME)}) AND (r = 1 OR length(text) > 2) AS ok FROM ranked) SELECT image_id, arg_min(text, r) FILTER (ok) AS commodity_name FROM fit GROUP BY 1""",
    "text_normalised": f"WITH {LABELS} SELECT image_id, text FROM texts",
    "document_contacts": rf"""WITH r AS (SELECT doc_id, text, regexp_extract(text, {quoted('(?is)(' + fixed.CARE + r'.*)')}, 1) AS tail FROM documents), g AS (SELECT doc_id, text, CASE WHEN tail <> '' THEN substr(tail, 1, 200) ELSE text END AS region FROM r)
      SELECT doc_id, {trimmed(f"coalesce({hit('region', fixed.PHONE, 0, '')}, {hit('text', fixed.PHONE, 0, '')})")} AS phone, coalesce({hit('region', r'[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.]+')}, {hit('text', r'[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.]+')}) AS email FROM g""",
    "document_scripts": r"SELECT doc_id, regexp_matches(text, '[\x{0900}-\x{097F}]') AS hindi, regexp_matches(text, '[A-Za-z]') AS english FROM documents",
    "report_strings": """WITH t AS (SELECT *, '₹ “a” – b… ' || text AS t, text AS s, sha256(text) AS h FROM documents)
      SELECT doc_id, regexp_replace(""" + "".join("replace(" for _ in fixed.REPORT_CHARACTERS) + "t" + "".join(f", {quoted(a)}, {quoted(b)})" for a, b in fixed.REPORT_CHARACTERS.items()) + r""", '[^\x{00}-\x{FF}]', '?', 'g') AS latin,
      CASE WHEN length(s) > 40 THEN substr(s, 1, 38) || '..' ELSE s END AS short, left(h, 6) || '...' || right(h, 4) AS masked, regexp_full_match(regexp_replace(text, '[ .,]', '-', 'g'), '[0-9A-Za-z-]+') AS safe, CAST('.' || n_chars AS DOUBLE) AS number FROM t""",
    "gtin_facts": f"""WITH codes AS (SELECT p_partkey AS package_id, {code_of('p_partkey')} AS code FROM part WHERE p_partkey % 13 <> 0), {FACTS}
      SELECT package_id, digits, CAST(length(digits) AS INTEGER) AS length, format, format IS NOT NULL AS is_gtin_length, checksum_valid, prefix, country, coalesce(prefix = '890', false) AS is_india, restricted_reason IS NOT NULL AS is_restricted, restricted_reason, gtin14,
      format IS NOT NULL AND checksum_valid AND restricted_reason IS NULL AS is_valid, concat_ws(' | ', CASE WHEN format IS NULL THEN length(digits) || {quoted(fixed.NOTE_LENGTH[2:])} WHEN NOT checksum_valid THEN {quoted(fixed.NOTE_CHECK)} END,
      CASE WHEN restricted_reason IS NOT NULL THEN 'Prefix ' || prefix || ' is reserved: ' || restricted_reason || '. This is not a consumer product GTIN.' END, CASE WHEN prefix = '890' THEN {quoted(fixed.NOTE_INDIA)} END) AS notes FROM facts""",
    "scanner_codes": f"""WITH {ECONOMIES}, c AS (SELECT p_partkey AS package_id, coalesce({code_of('p_partkey')}, '') AS digits, ['EAN13', 'UPCA', 'QRCODE', 'CODE128', 'EAN8', 'UPCE', 'ITF'][p_partkey % 7 + 1] AS kind FROM part)
      SELECT package_id, digits AS code, kind, economy, CASE WHEN kind = 'EAN13' OR (kind LIKE '%EAN%' AND length(digits) = 13) THEN length(digits) = 13 AND {check(BODY)} = TRY_CAST(right(digits, 1) AS INTEGER)
      WHEN kind = 'UPCA' OR (kind LIKE '%UPC%' AND length(digits) = 12) THEN length(digits) = 12 AND {check(BODY)} = TRY_CAST(right(digits, 1) AS INTEGER) WHEN kind IN ('QRCODE', 'CODE128') THEN length(digits) > 0 ELSE true END AS valid
      FROM c LEFT JOIN economies ON length(digits) >= 3 AND TRY_CAST(substr(digits, 1, 3) AS INTEGER) BETWEEN low AND high""",
    "first_codes": """WITH e AS (SELECT user_id AS image_id, props ->> '$.k' AS code, min(event_id) AS scan_no FROM events GROUP BY 1, 2) SELECT image_id, code, scan_no, row_number() OVER (PARTITION BY image_id ORDER BY scan_no) = 1 AS is_first FROM e""",
    "code_variants": """WITH c AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS gtin FROM part) SELECT DISTINCT gtin, unnest([gtin, ltrim(gtin, '0'), lpad(gtin, 13, '0'), lpad(gtin, 14, '0')]) AS variant FROM c""",
    "clear_space": f"""WITH {BOXES}, pairs AS (SELECT a.*, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, abs(a.x1 - b.x1) < 2 AND abs(a.y1 - b.y1) < 2 AND abs(a.x2 - b.x2) < 2 AND abs(a.y2 - b.y2) < 2 AS same FROM boxes a JOIN boxes b USING (image_id)),
      c AS (SELECT *, NOT same AND x1 < bx2 AND bx1 < x2 AS across, NOT same AND y1 < by2 AND by1 < y2 AS beside FROM pairs)
      SELECT image_id, box_no, round(min(CASE WHEN across AND by2 <= y1 THEN y1 - by2 END) / 2.5, 6) AS above_mm, round(min(CASE WHEN across AND by1 >= y2 THEN by1 - y2 END) / 2.5, 6) AS below_mm,
      round(min(CASE WHEN beside AND bx2 <= x1 THEN x1 - bx2 END) / 2.5, 6) AS left_mm, round(min(CASE WHEN beside AND bx1 >= x2 THEN bx1 - x2 END) / 2.5, 6) AS right_mm FROM c GROUP BY 1, 2""",
    "panel_rules": """WITH p AS (SELECT p_partkey AS package_id, CAST(p_size * p_size * 10.0 AS DOUBLE) AS a, p_size * 10 <= 200 AS small, p_size / 50.0 AS x, p_retailprice / 1000.0 AS y FROM part)
      SELECT package_id, CAST(CASE WHEN a <= 50 THEN 1.0 WHEN a <= 100 THEN 1.5 WHEN a <= 500 THEN 2.5 WHEN a <= 2500 THEN 4.0 ELSE 6.0 END AS DOUBLE) AS least_mm, CAST(CASE WHEN a <= 50 THEN 1.0 WHEN a <= 100 THEN CASE WHEN small THEN 1.0 ELSE 1.5 END WHEN a <= 500 THEN CASE WHEN small THEN 2.0 ELSE 2.5 END WHEN a <= 2500 THEN 4.0 ELSE 6.0 END AS DOUBLE) AS least_small_mm,
      round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 2) AS contrast, CASE WHEN package_id % 2 = 0 THEN a / 25.0 ELSE a END AS panel_area FROM p""",
    "font_metrics": f"""WITH {BLOCKS}, c AS (SELECT *, 500.0 / ((image_id % 4) * 25.0) AS ppm, CAST((image_id % 30) * 100.0 AS DOUBLE) AS a, (block_no % 5) * 100.0 <= 200 AS small FROM blocks WHERE image_id % 4 > 0),
      d AS (SELECT *, CAST(CASE WHEN a <= 50 THEN 1.0 WHEN a <= 100 THEN CASE WHEN small THEN 1.0 ELSE 1.5 END WHEN a <= 500 THEN CASE WHEN small THEN 2.0 ELSE 2.5 END WHEN a <= 2500 THEN 4.0 ELSE 6.0 END AS DOUBLE) AS least_mm FROM c)
      SELECT image_id, block_no, round(height_px / ppm, 2) AS height_mm, round(width_px / ppm, 2) AS width_mm, least_mm, height_px / ppm >= least_mm AS meets FROM d""",
    "ruler": """WITH t AS (SELECT DISTINCT l_orderkey AS image_id, CAST(l_linenumber * 10 + l_quantity % 4 AS DOUBLE) AS x FROM lineitem), g AS (SELECT image_id, x - lag(x) OVER (PARTITION BY image_id ORDER BY x) AS gap FROM t),
      m AS (SELECT image_id, median(gap) AS med, count(*) AS ticks FROM g GROUP BY 1) SELECT image_id, round(avg(gap), 9) AS pixels_per_mm, any_value(ticks) AS ticks FROM g JOIN m USING (image_id) WHERE med > 0 AND abs(gap - med) / med < 0.30 AND ticks >= 5 GROUP BY 1 HAVING count(*) >= 4""",
    "label_regions": f"""WITH RECURSIVE {BLOCKS}, r AS (SELECT image_id, block_no, text, cx, cy, lft AS x1, top AS y1, lft + wide AS x2, top + tall + 2 AS y2 FROM blocks),
      s AS (SELECT image_id, sqrt(max(x2) * max(x2) + max(y2) * max(y2)) * 50.0 / 1000 AS eps FROM r WHERE image_id % 7 > 0 GROUP BY 1),
      near AS (SELECT a.image_id, a.block_no AS a, b.block_no AS b FROM r a JOIN r b USING (image_id) JOIN s USING (image_id) WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= eps * eps AND a.block_no <> b.block_no),
      reach(image_id, a, b) AS (SELECT image_id, a, b FROM near UNION SELECT r.image_id, r.a, n.b FROM reach r JOIN near n ON r.image_id = n.image_id AND r.b = n.a),
      roots AS (SELECT image_id, a, least(a, min(b)) AS root FROM reach GROUP BY 1, 2), numbered AS (SELECT image_id, a, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS region FROM roots),
      held AS (SELECT r.*, CAST(coalesce(region, -1) AS INTEGER) AS region FROM r JOIN s USING (image_id) LEFT JOIN numbered n ON r.image_id = n.image_id AND r.block_no = n.a)
      SELECT image_id, region, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY cy, block_no) AS text, count(*) AS blocks FROM held GROUP BY 1, 2
      UNION ALL SELECT image_id, 0, NULL, NULL, NULL, NULL, string_agg(text, ' ' ORDER BY block_no), count(*) FROM r WHERE image_id % 7 = 0 GROUP BY 1""",
    "single_regions": f"""WITH {BLOCKS}, r AS (SELECT image_id, string_agg(text, ' ' ORDER BY block_no) AS text, count(*) AS blocks, max(lft + wide) AS w, max(top + tall + 2) AS h, image_id % 7 > 0 AS sized FROM blocks GROUP BY image_id)
      SELECT image_id, 0::INTEGER AS region, CASE WHEN sized THEN 0.0::DOUBLE END AS x1, CASE WHEN sized THEN 0.0::DOUBLE END AS y1, CASE WHEN sized THEN w END AS x2, CASE WHEN sized THEN h END AS y2, text, blocks FROM r""",
    "regions": """WITH RECURSIVE p AS (SELECT label AS image_id, vec_id AS n, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
      near AS (SELECT a.image_id, a.n AS a, b.n AS b FROM p a JOIN p b USING (image_id) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05), core AS (SELECT image_id, a FROM near GROUP BY 1, 2 HAVING count(*) >= 2),
      reach(image_id, a, b) AS (SELECT image_id, a, b FROM near WHERE a <> b UNION SELECT r.image_id, r.a, n.b FROM reach r JOIN near n ON r.image_id = n.image_id AND r.b = n.a),
      roots AS (SELECT image_id, a, least(a, min(b)) AS root FROM reach GROUP BY 1, 2), numbered AS (SELECT image_id, a, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INTEGER) AS region FROM roots),
      held AS (SELECT p.image_id, coalesce(region, -1) AS region, x, y FROM p LEFT JOIN numbered ON p.image_id = numbered.image_id AND p.n = numbered.a)
      SELECT image_id, region, round(min(x), 6) AS x1, round(min(y), 6) AS y1, round(max(x), 6) AS x2, round(max(y), 6) AS y2, count(*) AS points FROM held GROUP BY 1, 2""",
    "permitted_errors": """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 WHEN 2 THEN 100.0 ELSE 500.0 END::DOUBLE AS q, l_quantity, p_partkey % 6 AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
      e AS (SELECT *, CASE WHEN c < 2 THEN CASE WHEN q <= 50 THEN q * 0.09 WHEN q <= 200 THEN 4.5 WHEN q <= 300 THEN 9.0 WHEN q <= 500 THEN q * 0.03 WHEN q <= 1000 THEN 15.0 WHEN q <= 10000 THEN q * 0.015 WHEN q <= 15000 THEN 150.0 ELSE q * 0.01 END
        WHEN c = 2 THEN q * CASE WHEN q <= 10 THEN 0.02 ELSE 0.01 END WHEN c = 3 THEN q * CASE WHEN q <= 10 THEN 0.04 ELSE 0.01 END WHEN c = 4 THEN q * 0.02 ELSE 0.0 END AS m,
        CASE WHEN c < 2 THEN CASE WHEN q <= 50 THEN '9% of declared quantity' WHEN q <= 200 THEN '4.5 g/ml' WHEN q <= 300 THEN '9 g/ml' WHEN q <= 500 THEN '3% of declared quantity' WHEN q <= 1000 THEN '15 g/ml' WHEN q <= 10000 THEN '1.5% of declared quantity' WHEN q <= 15000 THEN '150 g/ml' ELSE '1% of declared quantity' END
        WHEN c = 2 THEN CASE WHEN q <= 10 THEN '2%' ELSE '1%' END || ' of declared length' WHEN c = 3 THEN CASE WHEN q <= 10 THEN '4%' ELSE '1%' END || ' of declared area' WHEN c = 4 THEN '2% of declared number' ELSE 'Unknown category, 0 error allowed' END AS basis FROM c)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(q AS DOUBLE) AS declared, round(CAST(q - (q - l_quantity) AS DOUBLE), 6) AS deficiency, round(CAST(m AS DOUBLE), 6) AS limit_value, basis, q - (q - l_quantity) <= m AS complies FROM e""",
    "standard_quantities": f"""WITH s(no, kind, allowed) AS (VALUES {", ".join(f"({i}, {quoted(n)}, {fixed.STANDARD_QUANTITIES[n]}::DOUBLE[])" for i, n in enumerate(sorted(fixed.STANDARD_QUANTITIES)))}),
      p AS (SELECT p_partkey AS package_id, p_partkey % 17 AS no, CAST(p_size * 25.0 AS DOUBLE) AS q FROM part)
      SELECT package_id, coalesce(kind, 'unknown') AS kind, coalesce(list_contains(allowed, q), false) AS standard, list_sort(list_transform(allowed, lambda v: [abs(v - q), v]))[1][2] AS nearest FROM p LEFT JOIN s USING (no)""",
    "unit_table": f"""WITH u(raw, unit, category) AS (VALUES {values([(k, v, c) for c, t in fixed.PACKAGE_UNITS.items() for k, v in t.items()])}), p AS (SELECT p_partkey AS package_id, ['GMS', ' Kg.', 'ltr', 'cl', 'tablets', 'SqM', 'nos', 'mm', 'Milliliter', 'U'][p_partkey % 10 + 1] AS r FROM part)
      SELECT package_id, coalesce(unit, r) AS unit, coalesce(category, 'number') AS category, {UNIT_CASE.format('r')} AS label_unit FROM p LEFT JOIN u ON u.raw = replace(trim(lower(r)), '.', '')""",
    "package_table": f"""WITH {PACKAGES} SELECT package_id, analysis_source, commodity_name, manufacturer_address, country_of_origin, net_quantity_value, net_quantity_unit, net_quantity_category, mrp_value, manufacture_date, is_imported, barcode_value, barcode_gtin_format, barcode_checksum_valid, barcode_country, barcode_is_restricted FROM packages""",
    "merged_sides": f"""WITH {PACKAGES}, f AS (SELECT *, CASE WHEN package_id % 2 = 0 THEN commodity_name END AS fname, CASE WHEN package_id % 3 <> 0 THEN mrp_value END AS fprice, package_id % 4 < 3 AS back FROM packages)
      SELECT package_id, coalesce(fname, CASE WHEN back THEN 'Back name' END) AS commodity_name, coalesce(fprice, CASE WHEN back THEN mrp_value END) AS mrp_value, coalesce(mrp_includes_tax, false) AS mrp_includes_tax, has_english_text, CAST(NULL AS VARCHAR) AS country_of_origin, CAST(NULL AS BOOLEAN) AS barcode_is_gs1_india,
      round(CASE WHEN total_text_blocks + CASE WHEN back THEN 5 ELSE 0 END > 0 THEN (average_ocr_confidence * total_text_blocks + CASE WHEN back THEN 2.5 ELSE 0 END) / (total_text_blocks + CASE WHEN back THEN 5 ELSE 0 END) ELSE 0 END, 9) AS average_ocr_confidence, CAST(total_text_blocks + CASE WHEN back THEN 5 ELSE 0 END AS INTEGER) AS total_text_blocks, package_type FROM f""",
    "package_features": f"""WITH {PACKAGES} SELECT package_id, CAST({has('commodity_name')} AS INTEGER) AS has_commodity_name, CAST({has('manufacturer_name')} AS INTEGER) AS has_manufacturer_name, CAST({has('manufacturer_address')} AS INTEGER) AS has_manufacturer_address,
      CAST({has('packer_name')} OR {has('packer_address')} AS INTEGER) AS has_packer_info, CAST(net_quantity_value IS NOT NULL AS INTEGER) AS has_net_quantity, CAST(mrp_value IS NOT NULL AS INTEGER) AS has_mrp, CAST({has('manufacture_date')} AS INTEGER) AS has_mfg_date, CAST({has('best_before')} AS INTEGER) AS has_expiry_date,
      CAST({has('consumer_care_phone')} AS INTEGER) AS has_consumer_care_phone, CAST({has('consumer_care_email')} AS INTEGER) AS has_consumer_care_email, CAST(has_fssai_logo OR {has('fssai_license_number')} AS INTEGER) AS has_fssai, CAST(has_veg_nonveg_symbol AS INTEGER) AS has_veg_nonveg_symbol, CAST(has_barcode AS INTEGER) AS has_barcode,
      0 AS has_hindi, CAST(has_english_text AS INTEGER) AS has_english, CAST(on_panel AS INTEGER) AS on_principal_panel, price_height AS mrp_font_height_mm, quantity_height AS net_qty_font_height_mm, min_height AS min_font_height_mm, mrp_contrast_ratio,
      round(CASE WHEN quantity_height <> 0 THEN least(above, below, "left", "right") / quantity_height END, 9) AS qty_clear_space_ratio, panel_area AS panel_area_mm2, net_quantity_value, mrp_value, average_ocr_confidence AS avg_ocr_confidence,
      {" + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("commodity_name", "manufacturer_name", "manufacturer_address", "packer_name", "packer_address", "importer_name", "importer_address", "net_quantity_value", "mrp_value", "manufacture_date", "expiry_date", "best_before", "consumer_care_phone", "consumer_care_email"))} AS num_declarations_found, CAST(is_imported AS INTEGER) AS is_imported FROM packages""",
    "rule_results": f"WITH {RESULTS} SELECT package_id, rule_no, rule_id, status, severity, weight FROM results",
    "one_rule": f"WITH {RESULTS} SELECT package_id, rule_id, status FROM results WHERE rule_id = 'R06_MRP'",
    "isolated_rules": f"""WITH {RESULTS} SELECT package_id, rule_id, CASE WHEN rule_id = 'R06_MRP' THEN 'INCONCLUSIVE' ELSE status END AS status, CASE WHEN rule_id = 'R06_MRP' THEN 'MINOR' ELSE severity END AS severity,
      CASE WHEN rule_id = 'R06_MRP' THEN CAST(0 AS DOUBLE) ELSE weight END AS weight, rule_id = 'R06_MRP' AS failed FROM results WHERE rule_id IN ('R06_MRP', 'R06_NAME')""",
    "rule_counts": f"""WITH {RESULTS} SELECT package_id, CAST(passed AS INTEGER) AS pass, CAST(failed AS INTEGER) AS fail, CAST(warned AS INTEGER) AS warning, CAST(none_n AS INTEGER) AS not_applicable, CAST(inc_n AS INTEGER) AS inconclusive, CAST(total AS INTEGER) AS total, CASE WHEN crit > 0 THEN 0 ELSE 1 END AS weak_label FROM sums""",
    "label_scores": f"""WITH {RESULTS}, s AS (SELECT sums.*, CASE WHEN judged_w > 0 THEN passed_w / judged_w ELSE 1.0 END AS r FROM sums JOIN packages USING (package_id) WHERE analysis_source = 'image'), t AS (SELECT *, 0.3 * CAST(0.5 AS DOUBLE) + (1 - CAST(0.3 AS DOUBLE)) * r AS f FROM s)
      SELECT package_id, round(r, 9) AS rule_score, round(f, 9) AS final_score, {STARS.format('f')} AS star_rating, {STAR_LABELS.format('f')} AS star_label, CAST(passed + failed + warned AS INTEGER) AS total_applicable_rules, CAST(passed AS INTEGER) AS passed_rules, CAST(failed AS INTEGER) AS failed_rules, CAST(crit AS INTEGER) AS critical_failures, CAST(maj AS INTEGER) AS major_failures, CAST(minor AS INTEGER) AS minor_failures FROM t""",
    "registry_scores": f"""WITH {RESULTS}, s AS (SELECT sums.*, {OPEN_SCORE} AS f FROM sums JOIN packages USING (package_id) WHERE analysis_source = 'barcode_registry'),
      risk AS (SELECT package_id, string_agg(rule_id, '|' ORDER BY rule_no) AS risks FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY rule_no) AS n FROM results WHERE status = 'FAIL') WHERE n <= 5 GROUP BY 1)
      SELECT package_id, round(f, 3) AS final_score, {STARS.format('f')} AS star_rating, {STAR_LABELS.format('f')} || CASE WHEN open_n > 0 THEN ' — ' || open_n || ' mandatory declarations unverified' ELSE '' END AS star_label, CAST(passed + failed + warned + open_n AS INTEGER) AS total_applicable_rules,
      CAST(passed AS INTEGER) AS passed_rules, CAST(failed AS INTEGER) AS failed_rules, CAST(crit AS INTEGER) AS critical_failures, CAST(open_n AS INTEGER) AS unverified, f >= 0.7 AS predicted_compliant, coalesce(risks, '') AS risks FROM s LEFT JOIN risk USING (package_id)""",
    "registry_recommendations": f"""WITH {RESULTS}, o AS (SELECT package_id, count(*) AS n, string_agg(DISTINCT rule_name, ', ' ORDER BY rule_name) AS names FROM results JOIN names USING (rule_id) WHERE status = 'INCONCLUSIVE' AND severity <> 'MINOR' GROUP BY 1)
      SELECT package_id, CASE WHEN NOT product_identified THEN {quoted(fixed.NOT_REGISTERED)} ELSE '[ACTION] ' || n || ' mandatory declaration(s) could not be verified from registry data — physically inspect the pack for: ' || names || '.' END AS first_line,
      CAST(greatest(failed + warned, 1) + 1 + CASE WHEN product_identified THEN 0 ELSE 1 END AS INTEGER) AS n_lines FROM packages JOIN sums USING (package_id) JOIN o USING (package_id) WHERE analysis_source = 'barcode_registry'""",
    "severity_failures": f"WITH {RESULTS} SELECT status, severity, count(*) AS n, sum(weight) AS weight FROM results GROUP BY CUBE (status, severity)",
    "report_cells": f"""WITH {RESULTS}, s AS (SELECT sums.*, analysis_source, has_barcode, barcode_value, {OPEN_SCORE} AS f FROM sums JOIN packages USING (package_id)), t AS (SELECT *, round(f, 3) AS g, {STARS.format('f')} AS st FROM s)
      SELECT package_id, printf('%.1f%%', g * 100) AS percent, repeat('★', st) || repeat('☆', 5 - st) AS stars, concat_ws(' + ', 'front.jpg', CASE WHEN package_id % 2 = 0 THEN 'back.jpg' END, CASE WHEN has_barcode THEN '(barcode ' || barcode_value || ')' END) AS images, CAST(none_n + inc_n AS INTEGER) AS not_judged,
      CASE WHEN analysis_source = 'image' THEN 'local_ocr' ELSE 'barcode_registry' END AS mode, round(g * 100, 1) AS points FROM t""",
    "rule_details": f"""WITH {RESULTS}, d AS (SELECT r.package_id, r.rule_id, r.status, p.*, CASE r.rule_id {" ".join(f"WHEN '{k}' THEN {quoted(v[0])}" for k, v in ABSENT.items())} END AS what FROM results r JOIN packages p USING (package_id)
        WHERE rule_id IN ('R06_NAME', 'R10_ADDRESS', 'R11_NET_QTY', 'R06_MRP', 'R06_COO', 'R09_LANG')
        UNION ALL SELECT package_id, rule_id, split_part(o, '|', 1), p.*, NULL FROM (SELECT package_id, 'B01_GTIN_STRUCT' AS rule_id, {RULE_SQL['B01_GTIN_STRUCT']} AS o FROM packages UNION ALL SELECT package_id, 'B06_ORIGIN_CONSISTENCY', {RULE_SQL['B06_ORIGIN_CONSISTENCY']} FROM packages) JOIN packages p USING (package_id))
      SELECT package_id, rule_id, rule_name, status, CASE WHEN status IN ('FAIL', 'INCONCLUSIVE') AND what IS NOT NULL THEN CASE WHEN {REG} THEN what || ' is not carried in the bar-code registry data. It may still be printed on the pack — verify against the physical label.' ELSE what || ' is missing from the label.' END
        ELSE CASE rule_id WHEN 'R06_NAME' THEN 'Commodity name found: ''' || commodity_name || '''' WHEN 'R10_ADDRESS' THEN 'Address found on label.' WHEN 'R11_NET_QTY' THEN 'Net quantity: ' || net_quantity_value || ' ' || coalesce(net_quantity_unit, 'None') WHEN 'R06_MRP' THEN 'MRP found: ₹' || printf('%.2f', mrp_value)
          WHEN 'R06_COO' THEN CASE status WHEN 'PASS' THEN 'Country of origin declared: ' || country_of_origin || '.' WHEN 'FAIL' THEN 'Package appears to be imported but the country of origin is not declared.' ELSE 'No indication the package is imported — country of origin not mandatory.' END
          WHEN 'R09_LANG' THEN CASE status WHEN 'PASS' THEN 'Declarations found in: English.' WHEN 'FAIL' THEN 'No Hindi (Devanagari) or English text detected on the label.' ELSE 'Requires visual inspection of the physical label — not determinable from bar-code registry data alone.' END
          WHEN 'B01_GTIN_STRUCT' THEN CASE status WHEN 'PASS' THEN 'Bar code is a valid ' || barcode_gtin_format || ' number.' WHEN 'FAIL' THEN '''' || barcode_value || ''' is not a valid GTIN length (expected 8, 12, 13 or 14 digits).' ELSE 'No bar code was scanned or supplied.' END
          ELSE CASE status WHEN 'PASS' THEN 'Declared origin ''' || trim(country_of_origin) || ''' is consistent with the GS1 licensing economy.' WHEN 'WARNING' THEN 'Declared origin ''' || trim(country_of_origin) || ''' differs from the GS1 licensing economy ''' || barcode_country || '''. The GS1 prefix is not proof of origin; confirm against the label.' ELSE 'No country of origin available to cross-check against the GS1 prefix.' END END END AS detail,
        CASE WHEN status = 'PASS' THEN CASE rule_id WHEN 'R06_NAME' THEN commodity_name WHEN 'R10_ADDRESS' THEN {ADDRESS} WHEN 'R11_NET_QTY' THEN net_quantity_value || ' ' || coalesce(net_quantity_unit, 'None') WHEN 'R06_MRP' THEN '₹' || printf('%.2f', mrp_value) WHEN 'R06_COO' THEN country_of_origin WHEN 'B01_GTIN_STRUCT' THEN barcode_value WHEN 'B06_ORIGIN_CONSISTENCY' THEN trim(country_of_origin) END
          WHEN rule_id = 'B01_GTIN_STRUCT' AND status = 'FAIL' THEN barcode_value WHEN rule_id = 'B06_ORIGIN_CONSISTENCY' AND status = 'WARNING' THEN 'declared=' || trim(country_of_origin) || '; prefix=' || barcode_country END AS evidence,
        CASE WHEN rule_id = 'R06_COO' THEN 'Rule 6 (imported packages)' WHEN rule_id = 'B01_GTIN_STRUCT' THEN 'Rule 6(10)' WHEN rule_id = 'B06_ORIGIN_CONSISTENCY' THEN 'Rule 6' WHEN rule_id = 'R09_LANG' AND status = 'FAIL' THEN 'Rule 9'
          WHEN status IN ('FAIL', 'INCONCLUSIVE') THEN CASE rule_id {" ".join(f"WHEN '{k}' THEN {quoted(v[1])}" for k, v in ABSENT.items())} END END AS legal_reference FROM d JOIN names USING (rule_id)""",
    "report_table": f"""WITH {RESULTS} SELECT package_id, CASE status WHEN 'PASS' THEN 1 WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'NOT_APPLICABLE' THEN 4 ELSE 5 END AS bucket_no, rule_no, substr(rule_id, 1, 20) AS id_cell, CASE WHEN length(rule_name) > 30 THEN substr(rule_name, 1, 28) || '..' ELSE rule_name END AS name_cell, status FROM results JOIN names USING (rule_id)""",
    "model_readings": """WITH p AS (SELECT p_partkey AS package_id, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_size * 2.0 WHEN 1 THEN p_size / 50.0 ELSE 0.0 END AS raw FROM part),
      r AS (SELECT package_id, ['PASS', 'FAIL', 'WARNING', 'ODD', 'NOT_APPLICABLE'][(k + i) % 5 + 1] AS status, CASE (k + i) % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM p, range(4) t(i)),
      s AS (SELECT package_id, count(*) FILTER (status = 'PASS') AS a, count(*) FILTER (status = 'FAIL') AS b, count(*) FILTER (status = 'WARNING') AS c, count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') AS crit, count(*) FILTER (status = 'FAIL' AND severity = 'MAJOR') AS maj, count(*) FILTER (status = 'FAIL' AND severity = 'MINOR') AS minor FROM r GROUP BY 1),
      f AS (SELECT s.*, CAST(CASE WHEN raw > 1 THEN raw / 100 WHEN raw <= 0 AND a + b > 0 THEN a / (a + b + c) ELSE raw END AS DOUBLE) AS f FROM s JOIN p USING (package_id))
      SELECT package_id, round(f, 3) AS final_score, CASE WHEN f * 100 >= 85 THEN 5 WHEN f * 100 >= 70 THEN 4 WHEN f * 100 >= 50 THEN 3 WHEN f * 100 >= 35 THEN 2 ELSE 1 END AS star_rating,
      CASE WHEN f * 100 >= 85 THEN 'Fully Compliant' WHEN f * 100 >= 70 THEN 'Substantially Compliant' WHEN f * 100 >= 50 THEN 'Partially Compliant' WHEN f * 100 >= 35 THEN 'Non-Compliant' ELSE 'Critical Violations' END AS star_label, CAST(a AS INTEGER) AS passed_rules, CAST(b AS INTEGER) AS failed_rules, CAST(crit AS INTEGER) AS critical_failures, CAST(maj AS INTEGER) AS major_failures, CAST(minor AS INTEGER) AS minor_failures FROM f""",
    "data_urls": "SELECT page_id, url FROM pages",
    "scan_facts": f"""WITH {ECONOMIES}, s AS (SELECT event_id, user_id AS device, '890' || lpad(regexp_replace(coalesce(props ->> '$.k', ''), '[^0-9]', '', 'g'), 9, '0') AS digits FROM events)
      SELECT event_id, device, digits AS code, {LENGTHS} AS format, economy AS country, {check(BODY)} = CAST(right(digits, 1) AS INTEGER) AS is_valid FROM s LEFT JOIN economies ON CAST(substr('00' || digits, 2, 3) AS INTEGER) BETWEEN low AND high""",
    "scans_per_minute": "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS scans FROM events GROUP BY 1",
    "calibrations": """WITH p AS (SELECT p_partkey AS package_id, p_partkey AS k, p_size FROM part), c AS (SELECT *, CASE WHEN k % 5 = 0 AND k % 7 > 0 THEN CAST(k % 7 AS DOUBLE) END AS r, CASE WHEN k % 3 = 0 AND k % 4 > 0 THEN p_size * 10.0 / ((k % 4) * 25.0) END AS h, CASE WHEN k % 90 > 10 THEN (k % 90) / CAST(37.29 AS DOUBLE) END AS b FROM p),
      d AS (SELECT *, CAST(coalesce(r, h, b) AS DOUBLE) AS ppm FROM c) SELECT package_id, round(ppm, 9) AS pixels_per_mm, CASE WHEN r IS NOT NULL THEN 'ruler' WHEN h IS NOT NULL THEN 'user_dimension' WHEN b IS NOT NULL THEN 'barcode' END AS method,
      CAST(CASE WHEN r IS NOT NULL THEN 0.9 WHEN h IS NOT NULL THEN 0.85 WHEN b IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.65 END END AS DOUBLE) AS confidence, round(CAST(CASE WHEN ppm IS NOT NULL THEN p_size * 100.0 / (ppm * ppm) ELSE p_size * 100.0 END AS DOUBLE), 6) AS panel_mm2 FROM d""",
    "least_heights": f"WITH {BLOCKS}, h AS (SELECT image_id, round(height_px / 4.0 - 3.0, 2) AS h FROM blocks) SELECT image_id, min(h) FILTER (h > 0) AS min_font_height_mm FROM h GROUP BY 1",
    "code_packages": """WITH e AS (SELECT user_id, arg_min(props ->> '$.k', event_id) AS code FROM events GROUP BY 1) SELECT p_partkey AS package_id, code AS barcode_value, code IS NOT NULL AS has_barcode FROM part LEFT JOIN e ON user_id = p_partkey""",
    "declared_packages": """SELECT p_partkey AS package_id, p_name AS commodity_name, CAST(p_size AS DOUBLE) AS net_quantity_value, CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE 'l' END AS net_quantity_unit, CASE WHEN p_partkey % 2 = 0 THEN 'weight' ELSE 'volume' END AS net_quantity_category, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS mrp_value, p_partkey % 3 = 0 AS mrp_includes_tax FROM part""",
    "reading_packages": f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN {code_of('p_partkey')} END AS code FROM part) SELECT p_partkey AS package_id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS commodity_name, p_retailprice AS mrp_value, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS net_quantity_value, 'g' AS net_quantity_unit,
      CASE WHEN p_partkey % 3 = 0 THEN '01/24' ELSE '05/24' END AS manufacture_date, 'care' AS consumer_care_email, code IS NOT NULL AS has_barcode, code AS barcode_value, CASE WHEN code IS NOT NULL THEN CASE WHEN length(code) = 13 THEN 'EAN-13' ELSE 'BARCODE' END END AS barcode_type FROM p""",
    "synthetic_training_rows": f"""WITH {MADE} SELECT label, has_mrp, has_english, count(*) AS n, sum(num_declarations_found)::BIGINT AS declarations, round(sum(mrp_font_height_mm), 3) AS mrp_font_height_mm, round(sum(min_font_height_mm), 3) AS min_font_height_mm,
      round(sum(panel_area_mm2), 3) AS panel_area_mm2, round(sum(mrp_value), 3) AS mrp_value, count(mrp_font_height_mm) AS n_mrp_font_height_mm, count(net_qty_font_height_mm) AS n_net_qty_font_height_mm, count(mrp_contrast_ratio) AS n_mrp_contrast_ratio FROM made GROUP BY 1, 2, 3""",
    "training_rows": f"""WITH {RESULTS}, {MADE}, both_ AS (SELECT 'real' AS origin, CASE WHEN crit > 0 THEN 0 ELSE 1 END AS label FROM sums JOIN packages USING (package_id) WHERE analysis_source = 'image' UNION ALL SELECT 'synthetic', label FROM made)
      SELECT origin, label::INTEGER AS label, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY origin))::DOUBLE, 9) AS share FROM both_ GROUP BY 1, 2""",
    "given_model_scores": f"""WITH {RESULTS}, f AS (SELECT package_id, mrp_value, price_height AS h, passed_w, judged_w,
        {" + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("commodity_name", "manufacturer_name", "manufacturer_address", "packer_name", "packer_address", "importer_name", "importer_address", "net_quantity_value", "mrp_value", "manufacture_date", "expiry_date", "best_before", "consumer_care_phone", "consumer_care_email"))} AS n
        FROM packages JOIN sums USING (package_id) WHERE analysis_source = 'image'),
      c AS (SELECT *, CAST(CASE WHEN mrp_value IS NULL THEN -1.5 ELSE 0.5 END AS DOUBLE) AS a, CAST(CASE WHEN h IS NULL THEN -0.25 WHEN h > 2.5 THEN 0.5 WHEN h > 1 THEN 0.25 ELSE -0.75 END AS DOUBLE) AS b, CAST(CASE WHEN n > 8 THEN 0.75 WHEN n > 5 THEN 0.125 ELSE -1.0 END AS DOUBLE) AS d,
        CAST(CASE WHEN mrp_value IS NULL THEN -0.125 WHEN mrp_value > 1400 THEN 0.25 WHEN mrp_value > 1000 THEN 0.125 ELSE 0.0 END AS DOUBLE) AS e FROM f),
      p AS (SELECT *, 1 / (1 + exp(-(0.25 + a + b + d + e))) AS p, CASE WHEN judged_w > 0 THEN passed_w / judged_w ELSE 1.0 END AS r FROM c), s AS (SELECT *, CAST(0.3 AS DOUBLE) * p + (1 - CAST(0.3 AS DOUBLE)) * r AS score FROM p)
      SELECT package_id, round(p, 9) AS probability, CAST(p >= 0.5 AS INTEGER) AS predicted, coalesce(list_aggregate(list_transform(list_sort(list_filter([{{'v': a, 'k': 'has_mrp'}}, {{'v': b, 'k': 'mrp_font_height_mm'}}, {{'v': d, 'k': 'num_declarations_found'}}, {{'v': e, 'k': 'has_mrp & mrp_value'}}], lambda x: x.v < 0)), lambda x: x.k), 'string_agg', '|'), '') AS risks,
        round(e, 9) AS pair, round(score, 9) AS final_score, {STAR_LABELS.format('score')} AS star_label FROM s""",
    "checked_rules": f"""WITH {RESULTS}, d AS (SELECT package_id, mrp_value AS m, CASE WHEN package_id % 6 = 0 THEN '0' WHEN package_id % 6 = 1 THEN 'ten' WHEN package_id % 6 > 2 THEN (package_id % 300)::VARCHAR END AS t FROM packages),
      n AS (SELECT *, TRY_CAST(t AS DOUBLE) AS q FROM d), e AS (SELECT *, CASE WHEN t IS NOT NULL AND q IS NULL THEN 'no double: ' || t WHEN q = 0 AND m IS NOT NULL THEN 'division by zero' END AS error, m / nullif(q, 0) AS p FROM n)
      SELECT package_id, 39::INTEGER AS rule_no, 'X01_UNIT_PRICE' AS rule_id, 'Unit price' AS rule_name, CASE WHEN error IS NOT NULL THEN 'INCONCLUSIVE' WHEN p IS NULL THEN 'NOT_APPLICABLE' WHEN p > 10 THEN 'FAIL' ELSE 'PASS' END AS status,
        CASE WHEN error IS NOT NULL OR p IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS weight, CASE WHEN error IS NOT NULL THEN 'Rule evaluation failed with error: ' || error WHEN p IS NULL THEN 'No unit price.' WHEN p > 10 THEN format('Unit price {{:.2f}}', p) ELSE 'Unit price in bounds.' END AS detail FROM e
      UNION ALL SELECT package_id, rule_no, rule_id, rule_name, status, weight, NULL FROM results JOIN names USING (rule_id) WHERE rule_id = 'R06_MRP'""",
    "rule_summaries": f"""WITH {RESULTS} SELECT package_id, 'PASS: ' || passed || ', FAIL: ' || failed || ', WARNING: ' || warned || ', NOT_APPLICABLE: ' || none_n || ', INCONCLUSIVE: ' || inc_n AS summary FROM sums""",
    "training_log": f"WITH {RESULTS} SELECT severity, rule_id, count(*) AS failures FROM results JOIN packages USING (package_id) WHERE analysis_source = 'image' AND status = 'FAIL' GROUP BY 1, 2",
    "label_packages": f"""WITH {LABELS}, q AS (SELECT image_id, k, text, {", ".join(f"{hit('text', fixed.NET_QUANTITY, i)} AS g{i}" for i in range(1, 10))} FROM texts), v AS (SELECT *, coalesce(CAST(g1 AS DOUBLE), CAST(g3 AS DOUBLE) * CAST(g4 AS DOUBLE), CAST(g6 AS DOUBLE), CAST(g8 AS DOUBLE)) AS value, {UNIT_CASE.format('coalesce(g2, g5, g7, g9)')} AS u0 FROM q),
      u(raw, unit, category) AS (VALUES {values([(k, v, c) for c, t in fixed.PACKAGE_UNITS.items() for k, v in t.items()])})
      SELECT image_id, value AS net_quantity_value, coalesce(unit, u0) AS net_quantity_unit, CASE WHEN u0 IS NOT NULL THEN coalesce(category, 'number') END AS net_quantity_category, k % 3 = 2 AS is_imported, true AS has_english_text, CASE WHEN k % 5 = 0 THEN '12 months' END AS best_before FROM v LEFT JOIN u ON raw = u0""",
}
ORACLES["sql_gtin_facts"] = ORACLES["gtin_facts"]
ORACLES["sql_declarations"] = ORACLES["label_declarations"]
ORACLES["sql_label_lines"] = f"""WITH {LABELS}, s AS (SELECT image_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS line_no FROM labels),
  l AS (SELECT image_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM s),
  q AS (SELECT *, coalesce({hit('line', PRICED, 1)}, {hit('line', PRICED, 2)}) AS digits, regexp_extract_all(line, {quoted(fixed.DECIMAL_PRICE)}, 1) AS found, {", ".join(f"{hit('line', fixed.NET_QUANTITY, i)} AS g{i}" for i in range(1, 10))} FROM l WHERE line <> '')
  SELECT image_id, line_no, line, coalesce(TRY_CAST(replace(digits, ',', '.') AS DOUBLE), list_max(list_filter(list_transform(found, lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 10 AND 99999))) AS price,
    coalesce(CAST(g1 AS DOUBLE), CAST(g3 AS DOUBLE) * CAST(g4 AS DOUBLE), CAST(g6 AS DOUBLE), CAST(g8 AS DOUBLE)) AS quantity FROM q"""
ORACLES["sql_audit"] = f"""WITH {RESULTS} SELECT analysis_source, r.rule_id, r.status, count(*) AS n, sum(r.weight) AS weight, count(*) FILTER (crit > 0) AS rejected
  FROM results r JOIN packages USING (package_id) JOIN sums USING (package_id) GROUP BY 1, 2, 3"""
ANSWERED = "p_partkey % 4 <> 1 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 7 <> 0"
ORACLES["knowledge_records"] = f"""SELECT lpad(p_partkey::VARCHAR, 13, '0') AS gtin, 'wikidata' AS source, p_name || ' ' AS product_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 5 < 3 THEN 'Maker' END AS manufacturer_name, CASE WHEN p_partkey % 2 = 0 THEN 'India' END AS country_of_origin FROM part WHERE {ANSWERED}"""
ORACLES["knowledge_labels"] = f"""WITH a AS (SELECT lpad(p_partkey::VARCHAR, 13, '0') AS gtin, * FROM part WHERE {ANSWERED}) SELECT gtin, 'itemLabel' AS label, p_name || ' ' AS value FROM a UNION ALL SELECT gtin, 'brandLabel', p_brand FROM a WHERE p_partkey % 3 = 0
  UNION ALL SELECT gtin, 'manufacturerLabel', 'Maker' FROM a WHERE p_partkey % 5 < 3 UNION ALL SELECT gtin, 'countryLabel', 'India' FROM a WHERE p_partkey % 2 = 0 UNION ALL SELECT gtin, 'boxLabel', p_type FROM a WHERE p_partkey % 6 = 0"""
ORACLES["malformed_payloads"] = """SELECT lpad(p_partkey::VARCHAR, 13, '0') AS gtin, 'wikidata' AS source, CASE WHEN p_partkey % 11 = 0 THEN 'no JSON' ELSE 'empty' END AS reason FROM part WHERE p_partkey % 4 <> 1 AND (p_partkey % 11 = 0 OR p_partkey % 13 = 0)"""
ORACLES["fallback_readings"] = """WITH a AS (SELECT p_partkey AS k, m, (p_partkey + m * 3) % 7 AS turn, p_name, p_size FROM part, range(3) r(m) WHERE NOT (p_partkey % 9 = 0 AND m > 0)),
  f AS (SELECT k, any_value(p_name) AS p_name, any_value(p_size) AS p_size, min(m) FILTER (turn IN (2, 3, 6)) AS m, arg_max(turn, m) AS last FROM a GROUP BY 1),
  r AS (SELECT k, m, string_agg(CASE WHEN (k + i) % 4 > 0 THEN 'L' || i || '-' || m || ':L' || i || '-' || m ELSE 'RULE:Rule' END || CASE WHEN (k + i) % 3 > 0 THEN ':PASS' ELSE ':INCONCLUSIVE' END || CASE WHEN (k + i) % 5 > 2 THEN ':MAJOR' ELSE ':MINOR' END, '|' ORDER BY i) AS rules FROM f, range(2) x(i) WHERE m IS NOT NULL GROUP BY 1, 2)
  SELECT f.k AS request_id, f.m::INTEGER AS model_no, CASE WHEN f.m IS NULL THEN CASE last WHEN 5 THEN 'HTTP 503' WHEN 1 THEN 'no text' ELSE 'no JSON' END END AS error, CASE WHEN f.m IS NOT NULL THEN p_name END AS product_name, rules, CASE WHEN f.m IS NOT NULL THEN round(p_size / 50.0, 3)::DOUBLE END AS final_score FROM f LEFT JOIN r USING (k)"""
ORACLES["device_sessions"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM e)
  SELECT user_id AS device, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS scans FROM n GROUP BY user_id, no"""
ORACLES["late_scans"] = """WITH e AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY xor(event_id, 255) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events), b AS (SELECT user_id, greatest(coalesce((epoch_us(before) - epoch_us(ts)) // 1000000, 0), 0) AS behind FROM e)
  SELECT user_id AS device, count(*) AS scans, count(*) FILTER (behind > 30) AS late, max(behind) AS behind FROM b GROUP BY 1"""
ORACLES["kept_documents"] = f"""WITH {RESULTS}, s AS (SELECT package_id, passed, open_n, {OPEN_SCORE} AS f FROM sums)
  SELECT package_id % 2 AS batch, package_id, {STAR_LABELS.format('f')} || CASE WHEN open_n > 0 THEN ' — ' || open_n || ' mandatory declarations unverified' ELSE '' END AS star_label, CAST(passed AS INTEGER) AS passed_rules, 8::INTEGER AS n_lines FROM s"""
ORACLES["report_documents"] = f"""WITH {RESULTS}, s AS (SELECT package_id, passed, open_n, {OPEN_SCORE} AS f FROM sums)
  SELECT package_id, {STAR_LABELS.format('f')} || CASE WHEN open_n > 0 THEN ' — ' || open_n || ' mandatory declarations unverified' ELSE '' END AS label, CAST(passed AS INTEGER) AS passed, 8::INTEGER AS n_lines FROM s"""
ORACLES["csv_scan"] = "SELECT p_partkey, p_name, p_size::INTEGER AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part WHERE p_partkey % 50 > 2 AND p_size > 10"
ORACLES["quarantined_lines"] = """SELECT CASE WHEN p_partkey % 50 = 1 THEN p_partkey::VARCHAR ELSE p_partkey || ',' || p_name || ',' || CASE WHEN p_partkey % 50 = 0 THEN 'large' ELSE p_size::VARCHAR END || ',' || p_retailprice::DOUBLE || CASE WHEN p_partkey % 50 = 2 THEN ',more' ELSE '' END END AS line
  FROM part WHERE p_partkey % 50 < 3"""
ORACLES["orc_scan"] = "SELECT p_partkey, p_name, p_size::INTEGER AS p_size, p_retailprice::DOUBLE AS p_retailprice, NULL::VARCHAR AS p_colour FROM part WHERE p_size > 10"
ORACLES["console_reports"] = f"""WITH {RESULTS}, s AS (SELECT package_id, passed, failed, warned, open_n, {OPEN_SCORE} AS f FROM sums), t AS (SELECT *, {STARS.format('f')} AS stars, {STAR_LABELS.format('f')} || CASE WHEN open_n > 0 THEN ' — ' || open_n || ' mandatory declarations unverified' ELSE '' END AS label FROM s)
  SELECT package_id, repeat('=', 60) || chr(10) || 'COMPLIANCE REPORT — ' || package_id || chr(10) || repeat('=', 60) || chr(10) || 'Rating: ' || repeat('★', stars) || repeat('☆', 5 - stars) || ' (' || label || ')' || chr(10) || 'Score: ' || printf('%.1f', round(f, 3) * 100) || '%' || chr(10)
    || 'Rules: ' || passed || ' passed, ' || failed || ' failed' AS head, CAST(9 + CASE WHEN failed > 0 THEN 2 + failed ELSE 0 END + greatest(1, failed + warned) AS INTEGER) AS n_lines, repeat('=', 60) AS foot FROM t"""
