"""Scalar functions. Missing values are NULL throughout: NaN and infinity never enter a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timestamps above this are milliseconds, those below seconds.
MILLISECONDS_FROM = 10_000_000_000
EPS = 1e-12


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI division would stop the job)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def number(c: Column | str) -> Column:
    """Any value as a finite double, else null."""
    d = F.col(c) if isinstance(c, str) else c
    d = d.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def sample_skewness(n: Column, population: Column, low: Column, high: Column) -> Column:
    """Bias-corrected skewness from the population moment; 0 for constant values, null below three."""
    value = F.sqrt(n * (n - 1)) / (n - 2) * population
    return F.when(n >= 3, F.when(low == high, 0.0).otherwise(value))


def sample_kurtosis(n: Column, population: Column, low: Column, high: Column) -> Column:
    """Bias-corrected excess kurtosis; -3 for constant values, null below four."""
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)
    return F.when(n >= 4, F.when(low == high, -3.0).otherwise(value))


def quantile(ordered: Column, n: int, q: float) -> Column:
    """Linear quantile of a sorted array of n values."""
    at = q * (n - 1)
    low = int(at)
    a = F.get(ordered, F.lit(low))
    return a if at == low else a + (F.get(ordered, F.lit(low + 1)) - a) * F.lit(at - low)


def entropy(ordered: Column, bins: int) -> Column:
    """Shannon entropy (natural log) of a sorted array's histogram of `bins` equal bins between least and greatest value.

    One fold: values of a bin follow each other, so the state is the bin, its count and the sum of c ln c so far.
    """
    n, low, high = F.size(ordered), F.get(ordered, F.lit(0)), F.element_at(ordered, -1)
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0.0).alias("s"))
    part = lambda c: F.when(c > 0, c * F.ln(c.cast("double"))).otherwise(0.0)

    def step(a: Column, v: Column) -> Column:
        b = F.least(F.floor(div(v - low, high - low) * bins).cast("int"), F.lit(bins - 1))
        same = b == a["b"]
        return F.struct(b.alias("b"), F.when(same, a["c"] + 1).otherwise(1).alias("c"), F.when(same, a["s"]).otherwise(a["s"] + part(a["c"])).alias("s"))

    total = F.aggregate(ordered, start, step, lambda a: F.ln(n) - (a["s"] + part(a["c"])) / n)
    return F.when(low == high, 0.0).otherwise(F.when(n > 0, total))


def log_return(x: Column, before: Column) -> Column:
    """Log return, null unless both are positive."""
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def simple_return(x: Column, before: Column) -> Column:
    return div(x - before, before)


def weighted_close(high: Column, low: Column, close: Column) -> Column:
    return (high + low + 2 * close) / 4


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


# --- time --------------------------------------------------------------------------------------------------


def unix_seconds(c: Column) -> Column:
    """Whole seconds since 1970 from seconds, milliseconds, numeric text or ISO-8601 text; else null."""
    text = c.cast("string")
    # Text that begins like a date is no number: trying the cast throws and catches an error in every row.
    n = number(F.when(~text.rlike("^[0-9]{4}-[0-9]{2}"), text))
    whole = F.when(n > MILLISECONDS_FROM, F.floor(n / 1000)).otherwise(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)))
    return F.coalesce(whole.cast("long"), F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))))


def timeframe_seconds(text: Column) -> Column:
    """'15m' -> 900; anything else than digits and m, h or d counts as 60."""
    n = F.regexp_extract(text, "^([0-9]+)[mhd]$", 1).try_cast("long")
    unit = F.when(text.endswith("m"), 60).when(text.endswith("h"), 3600).when(text.endswith("d"), 86400)
    return F.coalesce(n * unit, F.lit(60).cast("long"))


def age_seconds(at: Column, of: Column) -> Column:
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(of.cast("timestamp"))) / 1_000_000


# --- choice ------------------------------------------------------------------------------------------------


def first_true(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds; a null condition doesn't hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def side(c: Column) -> Column:
    """buy or sell from the names that payloads use."""
    low = F.lower(c)
    return F.when(low.isin("buy", "bid"), "buy").when(low.isin("sell", "ask"), "sell").otherwise(low)


def present(c: Column) -> Column:
    """c, null where it is 0, false or empty text: what `a or b` treats as missing."""
    return F.when((c.cast("string") != "") & ~c.cast("string").isin("0", "0.0", "false"), c)
