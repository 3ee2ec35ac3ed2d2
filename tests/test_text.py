"""Text functions against Python's re with the same fixed patterns."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from packlens.functions import fixed, text

TEXTS = [
    "M.R.P ₹599.00", "MRPz: something\nmore 1099.00", "₹ 599.00", "MRP599", "Rs 1,099", "MRP 200 g", "price 19.96 and 1234.50", "MRP Rs.45/- incl", "Net Wt 200 g", "3x10 Tablets", "30 Tablets",
    "5 g fat Net Wt 200 g", "NET QTY: 1.5 Ltr", "12X5 Sachets", "7 × 4 strips", "२०Og pack", "20Og", "a |099.00", "no numbers", "", "FSSAI Lic. No: 12345678901234", "fssai aa 10012345678901", "MFD: 02-MAR-2025 EXP 01-SEP-2026",
    "05/26 and 10/27", "Best before 12 months", "PKD Jan 2024", "Use by 12/2025 MFG 11/2024", "01.02.2024", "Customer Care call 1800 123 456 or a.b+c@d-e.co.in", "tel +91 98765 43210", "x 022-12345678 y", "Mfd by: A Ltd\n1 Road\nCity\nMRP 5", "Packed by  \nMktd by B",
    "Manufacturer - C & Co.\n\n Street 5 \n", "Imported by D", "हिन्दी", "Jahr 2024",
]
I = re.IGNORECASE


def lenient(t):
    t = t.translate(str.maketrans(fixed.DEVANAGARI, "0123456789"))
    t = re.sub(r"(\d+)O([a-zA-Z]+)", r"\g<1>0\2", t)
    return re.sub(r"(?<=\s)\|(\d{3,4}(?:\.\d{2})?)", r"1\1", t)


def price(t):
    m = re.search(fixed.MRP, t, I)
    if m and (m[1] or m[2]):
        return float((m[1] or m[2]).replace(",", ".")), m[0]
    best = [x for x in map(float, re.findall(fixed.DECIMAL_PRICE, t)) if 10 <= x <= 99999]
    return (max(best), f"₹ {max(best):.2f}") if best else (None, None)


def quantity(t):
    m = re.search(fixed.NET_QUANTITY, t, I)
    if not m:
        return None, None, None
    g = (None, *m.groups())
    value = float(g[1]) if g[1] else float(g[3]) * float(g[4]) if g[3] else float(g[6] or g[8])
    unit = (g[2] or g[5] or g[7] or g[9]).lower()
    return value, fixed.LABEL_UNITS.get(unit, unit), m[0]


def licence(t):
    m = re.search(fixed.LICENCE, t, I)
    at = t.upper().find("FSSAI")
    if not m and at >= 0:
        m = re.search(fixed.LICENCE_ALONE, t[max(0, at - 20) : at + 60])
    return m[1] if m else None


def dates(t):
    m, e = re.search(fixed.MADE_ON, t, I), re.search(fixed.EXPIRES_ON, t, I)
    made, exp, best = m and m[1].strip(), e and e[1].strip(), None
    if exp and re.search(fixed.DURATION, exp, I):
        exp, best = None, exp
    words = re.findall(fixed.ANY_DATE, t, I)
    if words:
        made = made or words[0]
    if len(words) > 1 and not exp and words[1] != made:
        exp = words[1]
    return made or None, exp or None, best


def party(t, role):
    m = re.search(fixed.PARTY[role], t, I)
    if not m:
        return None, None
    rest = t[m.end() : m.end() + 200]
    cut = re.search(fixed.PARTY_END, rest, I)
    lines = [x.strip() for x in (rest[: cut.start()] if cut else rest).split("\n") if x.strip()]
    return (lines[0] if lines else None), (", ".join(lines[1:]) or None)


def care(t):
    m = re.search(fixed.CARE, t, I)
    region = t[m.start() : m.start() + 200] if m else t
    phone = re.search(fixed.PHONE, region) or re.search(fixed.PHONE, t)
    email = re.search(fixed.EMAIL, region, I) or re.search(fixed.EMAIL, t, I)
    return phone and phone[0].strip(), email and email[0]


@pytest.fixture(scope="module")
def parsed(spark):
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", text.lenient_text(t).alias("l"), text.declarations(t).alias("d")).orderBy("i").collect()
    return [(lenient(x), r) for x, r in zip(TEXTS, rows, strict=True)]


def test_declarations_as_python_reads_them(parsed):
    for t, r in parsed:
        d = r.d
        assert r.l == t
        assert (d.mrp.value, d.mrp.raw) == price(t), t
        assert (d.quantity.value, d.quantity.unit, d.quantity.raw) == quantity(t), t
        assert d.fssai_license == licence(t), t
        assert (d.dates.made, d.dates.expires, d.dates.best_before) == dates(t), t
        assert (d.care.phone, d.care.email) == care(t), t
        made = party(t, "manufacturer")
        made = made if made[0] else party(t, "marketer")
        assert (d.parties.manufacturer.name, d.parties.manufacturer.address) == made, t
        for role in ("packer", "importer"):
            assert (d.parties[role].name, d.parties[role].address) == party(t, role), t


def test_known_readings(parsed):
    by = {t: r.d for t, (_, r) in zip(TEXTS, parsed, strict=True)}
    assert by["MRP599"].mrp.value == 99.0
    assert by["Rs 1,099"].mrp.value == 1.09
    assert by["MRP 200 g"].mrp.value == 20.0
    assert by["3x10 Tablets"].quantity.value == 30.0
    assert by["5 g fat Net Wt 200 g"].quantity.value == 5.0
    assert by["हिन्दी"].scripts.hindi and not by["हिन्दी"].scripts.english


def test_registry_strings(spark):
    t = F.col("t")
    df = spark.createDataFrame([("500 g",), ("1,5 L",), ("6 x 30 g",), (" box ",), (None,), ("",)], "t string")
    rows = [r.q for r in df.select(text.registry_quantity(t).alias("q")).collect()]
    assert [tuple(r) for r in rows] == [(500.0, "g", "500 g"), (1.5, "l", "1,5 L"), (30.0, "g", "30 g"), (None, None, "box"), (None, None, None), (None, None, None)]
    one = spark.range(1).select(
        text.clean(F.lit(" ,a, b,, ")).alias("clean"), text.clean(F.lit(" , ")).alias("none"), text.registry_price(F.lit("x"), F.lit("Rs. 12.50")).alias("price"), text.diet(F.array(F.lit("en:non-vegan"))).alias("diet"),
        text.pretty_tags(F.array(F.lit("en:south-africa"), F.lit("x"))).alias("tags"), text.report_text(F.lit("“₹5” ≤ ★é")).alias("latin"), text.masked(F.lit("0123456789abcdef")).alias("mask"), text.safe_id(F.lit("a-9")).alias("ok"), text.safe_id(F.lit("../x")).alias("bad")).first()
    assert tuple(one) == ("a, b", None, 12.5, "VEG", "South Africa, X", '"Rs5" <= ?é', "012345...cdef", True, False)


def test_two_decimals_are_those_of_the_exact_number(spark):
    rng = random.Random(3)
    values = [0.125, 0.375, 2.675, 1.005, 12.345, 0.005, 0.015, 0.994999, 0.995, 9.995, 99.999, -0.125, -1.005, 0.0, -0.0, -0.001, 1e-300, 2.0**52 + 0.5, 2.0**53, 1e17, math.inf, -math.inf, math.nan, None]
    values += [rng.choice((1, -1)) * round(rng.random() * 10 ** rng.randint(0, 9), 3) for _ in range(500)] + [rng.randint(1, 10**6) / 1000 / rng.choice((1, 2, 4, 8, 16, 299)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(values)), "n long, v double").select("n", "v", text.two_places(F.col("v")).alias("t"))
    for r in rows.collect():
        assert r.t == (None if r.v is None else f"{r.v:.2f}"), r.v
