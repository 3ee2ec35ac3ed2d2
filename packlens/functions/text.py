"""Text functions: Column expressions over label text and registry strings.

Patterns come from ``fixed``. They are matched as Java regular expressions with
Unicode classes; ``(?i)`` marks those that ignore case.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

UNICODE = "(?U)"
ANY_CASE = "(?iuU)"


def pattern(text: str, ignore_case: bool = True) -> Column:
    return F.lit((ANY_CASE if ignore_case else UNICODE) + text)


def found(text: Column, regex: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The group of the first match; null without a match or if the group took no part."""
    hit = F.regexp_extract(text, (ANY_CASE if ignore_case else UNICODE) + regex, group)
    return F.nullif(hit, F.lit(""))


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key`` in a small fixed table; null if it isn't there."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def truthy(value: Column) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(value != "", F.lit(False))


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of the values, each evaluated once however often ``f`` uses it: a lambda variable isn't expanded again."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(packed), lambda s: f(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def two_places(value: Column) -> Column:
    """A number with two decimals, rounded from its exact binary value, halves to the even digit (as C and Python print it; ``format_string`` rounds up what is written as a half).

    A fraction times 2**60 is a whole number, but for bits too small to matter. From
    2**53 on there are no fractions; from 2**63 on the digits are Spark's own.
    """

    def shown(x: Column) -> Column:
        size = F.abs(x)
        whole = F.when(size < 2.0**53, size).otherwise(0.0).cast("long")
        part = ((F.when(size < 2.0**53, size).otherwise(0.0) - whole) * 2.0**60).cast("long").cast("decimal(19,0)") * F.lit(100).cast("decimal(3,0)")
        unit = F.lit(2**60).cast("decimal(19,0)")
        down = F.floor(part / unit).cast("long")

        def rounded(down: Column, twice: Column) -> Column:
            return down + F.when((twice > unit) | ((twice == unit) & (down % 2 == 1)), 1).otherwise(0)

        def written(whole: Column, cents: Column) -> Column:
            return F.format_string("%s%d.%02d", F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""), whole + F.floor(cents / 100).cast("long"), cents % 100)

        small = bound(written, whole, bound(lambda part, down: rounded(down, (part - down.cast("decimal(19,0)") * unit) * 2), part, down))
        return F.when(F.isnan(x), "nan").when(size == math.inf, F.when(x < 0, "-inf").otherwise("inf")).when(size < 2.0**53, small).otherwise(F.format_string("%.2f", x))

    return F.when(value.isNotNull(), bound(shown, value.cast("double")))


def json_value(text: Column) -> Column:
    """The variant of a text that is JSON as a whole; null for any other, what has more behind its value included."""
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(held, "$[1]", "variant").isNull(), F.try_variant_get(held, "$[0]", "variant"))


def strip(value: Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def lenient_text(text: Column) -> Column:
    """Reader noise undone: Devanagari digits, the letter O inside numbers, a pipe before a price."""
    digits = F.translate(text, fixed.DEVANAGARI, "0123456789")
    zeros = F.regexp_replace(digits, UNICODE + r"(\d+)O([a-zA-Z]+)", "$10$2")
    return F.regexp_replace(zeros, UNICODE + r"(?<=\s)\|(\d{3,4}(?:\.\d{2})?)", "1$1")


def price(text: Column) -> Column:
    """``value, raw``: the first price after a keyword or currency; else the largest decimal price from 10 to 99999.

    The text is searched once for each; the digits are read from the short match.
    """
    decimals = F.transform(F.regexp_extract_all(text, pattern(fixed.DECIMAL_PRICE, False), 1), lambda x: x.try_cast("double"))
    best = F.array_max(F.filter(decimals, lambda x: x.between(10.0, 99999.0)))

    def chosen(raw: Column, best: Column) -> Column:
        return bound(lambda value: F.struct(F.coalesce(value, best).alias("value"), F.when(value.isNotNull(), raw).otherwise(F.when(best.isNotNull(), F.format_string("₹ %.2f", best))).alias("raw")),
                     F.replace(F.coalesce(found(raw, fixed.MRP, 1), found(raw, fixed.MRP, 2)), F.lit(","), F.lit(".")).try_cast("double"))

    return bound(chosen, found(text, fixed.MRP), best)


def label_unit(unit: Column) -> Column:
    return F.coalesce(lookup(fixed.LABEL_UNITS, F.lower(unit)), F.lower(unit))


def net_quantity(text: Column) -> Column:
    """``value, unit, raw`` of the leftmost quantity; ``A x B unit`` multiplies.

    The text is searched once; the groups are read from the short match.
    """

    def parts(raw: Column) -> Column:
        return bound(shaped, raw, *[found(raw, fixed.NET_QUANTITY, i) for i in range(1, 10)])

    def shaped(raw: Column, *group: Column) -> Column:
        number = [g.try_cast("double") for g in group]
        value = F.coalesce(number[0], number[2] * number[3], number[5], number[7])
        return bound(lambda v, unit: F.struct(v.alias("value"), F.when(v.isNotNull(), label_unit(unit)).alias("unit"), F.when(v.isNotNull(), raw).alias("raw")), value, F.coalesce(group[1], group[4], group[6], group[8]))

    return bound(parts, found(text, fixed.NET_QUANTITY))


def licence(text: Column) -> Column:
    """The 14-digit licence after its keyword, else a lone one from 20 characters before to 60 after the first FSSAI."""
    at = F.locate("FSSAI", F.upper(text)) - 1
    start = F.greatest(at - 20, F.lit(0))
    near = F.substring(text, start + 1, at + 60 - start)
    return F.coalesce(found(text, fixed.LICENCE, 1), F.when(at >= 0, found(near, fixed.LICENCE_ALONE, 1, False)))


def dates(text: Column) -> Column:
    """``made, expires, best_before``: by keyword, a duration being a best-before; else from the first two date-like words."""

    def shaped(made: Column, after: Column, words: Column, lasts: Column) -> Column:
        made_or = F.coalesce(made, F.get(words, F.lit(0)))
        second = F.get(words, F.lit(1))
        expires_or = F.coalesce(F.when(~lasts, after), F.when(second != F.coalesce(made_or, F.lit("")), second))
        return F.struct(made_or.alias("made"), expires_or.alias("expires"), F.when(lasts, after).alias("best_before"))

    def read(made: Column, after: Column, words: Column) -> Column:
        return bound(shaped, made, after, words, F.coalesce(after.rlike(ANY_CASE + fixed.DURATION), F.lit(False)))

    return bound(read, strip(found(text, fixed.MADE_ON, 1)), strip(found(text, fixed.EXPIRES_ON, 1)), F.regexp_extract_all(text, pattern(fixed.ANY_DATE), 1))


def party(text: Column, role: str) -> Column:
    """``name, address`` after a role's keyword: first line, and the other lines joined; nulls if the block is empty."""
    after = F.get(F.split(text, ANY_CASE + fixed.PARTY[role], 2), F.lit(1))
    block = strip(F.get(F.split(F.substring(after, 1, 200), ANY_CASE + fixed.PARTY_END, 2), F.lit(0)))
    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
    address = lambda held: F.when(F.size(held) > 1, F.array_join(F.slice(held, 2, 200), ", "))
    return bound(lambda held: F.struct(F.get(held, F.lit(0)).alias("name"), address(held).alias("address")), lines)


def parties(text: Column) -> Column:
    """Names and addresses of manufacturer, packer and importer; a marketer stands in for a missing manufacturer."""
    maker = bound(lambda made: F.when(made["name"].isNotNull(), made).otherwise(party(text, "marketer")), party(text, "manufacturer"))
    return F.struct(maker.alias("manufacturer"), party(text, "packer").alias("packer"), party(text, "importer").alias("importer"))


def consumer_care(text: Column) -> Column:
    """``phone, email``: first in the 200 characters from the care keyword, else in the whole text."""

    def read(region: Column) -> Column:
        phone = F.coalesce(found(region, fixed.PHONE, 0, False), found(text, fixed.PHONE, 0, False))
        email = F.coalesce(found(region, fixed.EMAIL), found(text, fixed.EMAIL))
        return F.struct(strip(phone).alias("phone"), strip(email).alias("email"))

    at = F.regexp_instr(text, pattern(fixed.CARE))
    return bound(read, bound(lambda at: F.when(at > 0, F.substring(text, at, F.lit(200))), at))


def scripts(text: Column) -> Column:
    """``hindi, english``: whether Devanagari or Latin letters occur."""
    return F.struct(F.coalesce(text.rlike(r"[ऀ-ॿ]"), F.lit(False)).alias("hindi"), F.coalesce(text.rlike("[A-Za-z]"), F.lit(False)).alias("english"))


def declarations(text: Column) -> Column:
    """All declarations that need only the text, as one struct; no shuffle."""

    def read(t: Column) -> Column:
        return F.struct(price(t).alias("mrp"), net_quantity(t).alias("quantity"), licence(t).alias("fssai_license"), dates(t).alias("dates"), parties(t).alias("parties"), consumer_care(t).alias("care"), scripts(t).alias("scripts"))

    return bound(read, lenient_text(text))


def registry_quantity(text: Column) -> Column:
    """``value, unit, raw`` of a registry's quantity text; without a match only the trimmed text; no multiplication."""
    number = found(text, fixed.REGISTRY_QUANTITY, 1)
    unit = F.lower(found(text, fixed.REGISTRY_QUANTITY, 2))
    raw = F.coalesce(found(text, fixed.REGISTRY_QUANTITY), F.nullif(strip(text), F.lit("")))
    return F.struct(F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("value"), F.coalesce(lookup(fixed.REGISTRY_UNITS, unit), unit).alias("unit"), raw.alias("raw"))


def registry_price(*texts: Column) -> Column:
    """The first price that one of the texts has after a currency or keyword."""
    return F.coalesce(*[found(t, fixed.REGISTRY_PRICE, 1).try_cast("double") for t in texts])


def clean(value: Column) -> Column:
    """White space, then commas off both ends; empty becomes null."""
    return F.nullif(F.regexp_replace(strip(value), "^,+|,+$", ""), F.lit(""))


def pretty_tags(tags: Column) -> Column:
    """Tags after their last colon, hyphens as spaces, in title case, joined; null if none."""
    words = F.transform(tags, lambda t: F.initcap(F.replace(F.substring_index(t, ":", -1), F.lit("-"), F.lit(" "))))
    return F.nullif(F.array_join(words, ", "), F.lit(""))


def diet(tags: Column) -> Column:
    """NON_VEG or VEG by what a list of tags contains; ``vegan`` anywhere counts as VEG."""
    text = F.array_join(tags, " ")
    return F.when(text.contains("non-vegetarian"), "NON_VEG").when(text.contains("vegetarian") | text.contains("vegan"), "VEG")


def categories(text: Column, separator: str) -> Column:
    """The first six parts that aren't blank."""
    return F.slice(F.filter(F.transform(F.split(text, separator), strip), lambda x: x != ""), 1, 6)


def says_tax_included(raw: Column) -> Column:
    low = F.lower(raw)
    return F.coalesce(low.contains("incl") | low.contains("all tax"), F.lit(False))


def report_text(text: Column) -> Column:
    """Typographic characters spelt out, others beyond Latin-1 as question marks."""
    spelt = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), fixed.REPORT_CHARACTERS.items(), text)
    return F.regexp_replace(spelt, r"[^\x{00}-\x{FF}]", "?")


def shortened(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last two being dots if cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 2), F.lit(".."))).otherwise(text)


def masked(secret: Column) -> Column:
    return F.concat(F.left(secret, F.lit(6)), F.lit("..."), F.right(secret, F.lit(4)))


def safe_id(value: Column) -> Column:
    """Whether a report id holds letters, digits and hyphens only."""
    return F.coalesce(value.rlike("^[0-9A-Za-z-]+$"), F.lit(False))


def number_of(text: Column) -> Column:
    """The number left when all but digits and dots are dropped."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
