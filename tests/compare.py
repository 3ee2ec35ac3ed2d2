"""Comparison of query results, whatever the order of rows."""

import math


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or type(value).__name__ == "NAType":
        return "null"
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))
