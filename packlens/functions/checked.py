"""Expressions that carry what went wrong instead of failing the query.

A ``Checked`` is a value with an error text, null where all went well. It is computed
with Spark's ``try_`` functions, so under ANSI no row can stop the others; an error
goes on through everything that is computed from it, the first one wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checked:
    value: Column
    error: Column


def plain(value: Column) -> Checked:
    """A value that can't fail."""
    return Checked(value, F.lit(None).cast("string"))


def combined(f: Callable[..., Column], *held: Checked, error: Column | None = None) -> Checked:
    """``f`` of the values, which must not fail itself, with their errors and ``error``."""
    errors = [h.error for h in held] + ([error] if error is not None else [])
    return Checked(f(*[h.value for h in held]), F.coalesce(*errors) if len(errors) > 1 else errors[0])


def quotient(a: Checked, b: Checked) -> Checked:
    return combined(F.try_divide, a, b, error=F.when((b.value == 0) & a.value.isNotNull(), F.lit("division by zero")))


def converted(a: Checked, kind: str) -> Checked:
    """``a`` as another type; text that doesn't read as one is an error."""
    held = a.value.try_cast(kind)
    return Checked(held, F.coalesce(a.error, F.when(a.value.isNotNull() & held.isNull(), F.concat(F.lit(f"no {kind}: "), a.value.cast("string")))))


def day(a: Checked, pattern: str) -> Checked:
    held = F.try_to_date(a.value, pattern)
    return Checked(held, F.coalesce(a.error, F.when(a.value.isNotNull() & held.isNull(), F.concat(F.lit("no date: "), a.value))))


def element(a: Checked, at: int) -> Checked:
    """The element of an array at a place from 0 on; a place that it doesn't have is an error."""
    missing = F.when(F.size(a.value) <= at, F.concat(F.lit(f"no element {at} of "), F.size(a.value).cast("string")))
    return combined(lambda x: F.get(x, F.lit(at)), a, error=missing)


def first_error(*held: Checked) -> Column:
    """The first error of several values, null if there is none."""
    return F.coalesce(*[h.error for h in held], F.lit(None).cast("string"))
