"""Growth, gaps and scores as column expressions. Money is in thousands of dollars throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of rows: decimal inside, double outside."""
    return F.sum(c.cast("decimal(20,4)")).cast("double")


def rounded(c: Column, digits: int) -> Column:
    """Rounded half up on the decimal value, which every engine does alike."""
    return F.round(c.cast("decimal(28,8)"), digits).cast("double")


def total_delta_pct(start: Column, end: Column) -> Column:
    """Change from ``start`` to ``end`` in percent; 0 where ``start`` is not positive."""
    return F.when(start > 0, (end - start) / start * 100).otherwise(F.lit(0.0))


def cagr_pct(start: Column, end: Column, years: int) -> Column:
    """Compound yearly growth in percent; 0 where an end is not positive or no year passed."""
    if years <= 0:
        return F.lit(0.0)
    return F.when((start > 0) & (end > 0), (F.pow(end / start, F.lit(1.0 / years)) - 1) * 100).otherwise(F.lit(0.0))


def yoy_pct(base: Column, budget: Column) -> Column:
    """Year-on-year change in percent; 100 for money where there was none, 0 for none on both sides."""
    return (
        F.when(base > 0, (budget - base) / base * 100).when(budget > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    )


def trend_label(first: Column, last: Column) -> Column:
    """Up or down beyond five percent, else flat."""
    return (
        F.when(last > first * 1.05, F.lit("↑ UP")).when(last < first * 0.95, F.lit("↓ DOWN")).otherwise(F.lit("→ FLAT"))
    )


def trend_arrow(first: Column, last: Column) -> Column:
    return F.substring(trend_label(first, last), 1, 1)


def safe_double(c: Column) -> Column:
    """A number from text or number; null for anything else, NaN included."""
    d = c.try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def confidence_badge(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def era(fiscal_year: Column) -> Column:
    """How the listing of a fiscal year is laid out."""
    return F.when(fiscal_year <= 2001, "legacy").when(fiscal_year <= 2016, "modern1").otherwise("modern2")


def fiscal_year_of(d: Column) -> Column:
    """The US fiscal year (October to September) a date falls in."""
    return F.year(d) + (F.month(d) >= 10).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * norm(b))
