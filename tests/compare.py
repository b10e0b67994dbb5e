"""Rows as sorted tuples of plain text, so that two engines' results compare."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.10g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if str(v) in ("NaT", "<NA>") else str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False))
