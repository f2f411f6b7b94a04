"""SQL expressions over ``array<double>`` / ``array<float>`` vectors.

Arguments are SQL expressions, usually column names.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: str, b: str) -> Column:
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * y), 0D, (s, x) -> s + x)"
    )


def norm_sql(v: str) -> str:
    return f"sqrt(aggregate({v}, 0D, (s, x) -> s + double(x) * x))"


def l2_norm(v: str) -> Column:
    return F.expr(norm_sql(v))


def unit_sql(v: str) -> str:
    # The one-element outer transform binds the norm once per row: inside the inner
    # lambda it would be computed again for every element.
    scaled = f"CASE WHEN n = 0 THEN {v} ELSE transform({v}, x -> x / n) END"
    return f"transform(array({norm_sql(v)}), n -> {scaled})[0]"


def unit(v: str) -> Column:
    """Scale to length 1; the zero vector stays as it is."""
    return F.expr(unit_sql(v))
