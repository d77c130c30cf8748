"""Column expressions shared by all plans. Everything stays JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_double() -> Column:
    return F.lit(None).cast("double")


def finite(x) -> Column:
    """NaN and infinities become NULL, the only missing value inside the library."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(num, den, *, positive: bool = True) -> Column:
    """Division that is NULL unless the denominator is usable."""
    num, den = c(num), c(den)
    ok = den > 0 if positive else den != 0
    return F.when(ok, num / den)


def pct(x: Column) -> Column:
    return x * 100.0


def nonzero_or(a, b) -> Column:
    """`a` unless it is NULL or zero, else `b` (a zero amount counts as not reported)."""
    return F.coalesce(F.nullif(c(a), F.lit(0.0)), c(b))


def parse_amount(x) -> Column:
    """'1,234' -> 1234, '(1,234)' -> -1234, '-' and blanks -> NULL."""
    raw = F.trim(c(x).cast("string"))
    digits = F.regexp_replace(raw, r"[^\d.\-]", "")
    value = F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits).try_cast("double")
    negative = raw.startswith("(") & raw.endswith(")")
    return F.when(raw.isin("", "-", "--", "nan", "None"), None).otherwise(
        F.when(negative, -value).otherwise(value))


def letter_grade(score) -> Column:
    from tidemark.spec import GRADE_CUTS
    s = c(score)
    out = F.when(s.isNull(), None)
    for cut, letter in GRADE_CUTS:
        out = out.when(s >= cut, letter)
    return out.otherwise("D")


def weighted(scores: dict[str, float], suffix: str = "_score") -> Column:
    """Weighted mean over the non-NULL members, weights renormalised.

    Rounded to ten decimals so that no comparison depends on the order of additions.
    """
    num = reduce(lambda a, b: a + b,
                 [F.coalesce(F.col(k + suffix), F.lit(0.0)) * float(w) for k, w in scores.items()])
    den = reduce(lambda a, b: a + b,
                 [F.when(F.col(k + suffix).isNotNull(), float(w)).otherwise(0.0)
                  for k, w in scores.items()])
    return F.round(F.when(den > 0, num / den), 10)


def present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(x).isNotNull().cast("int") for x in columns])


def two_sided_p(t: Column) -> Column:
    """Two-sided normal p-value erfc(|t|/sqrt 2), relative error below 1.2e-7.

    Spark has no erfc; this is the published Chebyshev fit of the complementary error function.
    """
    # fixed values: coefficients of the fit, highest order last
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = F.abs(t) / F.sqrt(F.lit(2.0))
    u = 1.0 / (1.0 + 0.5 * z)
    poly = reduce(lambda acc, a: F.lit(a) + u * acc, reversed(coef[:-1]), F.lit(coef[-1]))
    return u * F.exp(-z * z + poly)


def rank_correlation(x: str, y: str) -> Column:
    """Correlation of two columns as an aggregate, NULL where one of them is constant (`corr` divides by zero there)."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 3) & (sd > 0), mean / (sd / F.sqrt(n.cast("double"))))


def month_day5(start: Column, end: Column, day: int = 5) -> Column:
    """Array with day `day` of every month from start's month to end's month."""
    first = F.date_add(F.trunc(start, "month"), day - 1)
    last = F.date_add(F.trunc(end, "month"), day - 1)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))


def rebalance_days(start: Column, end: Column) -> Column:
    """Sorted array of the four dates per year that follow the filing deadlines."""
    # fixed values: month and day of each rebalance date
    days = [(4, 5), (5, 20), (8, 20), (11, 20)]
    years = F.sequence(F.year(start), F.year(end))
    per_year = F.transform(years, lambda y: F.array(*[F.make_date(y, F.lit(m), F.lit(d))
                                                      for m, d in days]))
    return F.filter(F.flatten(per_year), lambda d: (d >= start) & (d <= end))
