"""Order-insensitive comparison of a Spark result with an oracle result."""

from __future__ import annotations

import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, records):
    """Rows with columns sorted by name, values normalised, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def same(scols, srows, ocols, orows) -> tuple[bool, str]:
    if sorted(scols) != sorted(ocols):
        return False, f"columns {sorted(scols)} vs {sorted(ocols)}"
    a, b = rows_of(scols, srows), rows_of(ocols, orows)
    if a == b:
        return True, f"{len(a)} rows"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"rows {len(a)} vs {len(b)}; first diffs {diff}"
