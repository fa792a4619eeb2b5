"""Series: what tells one series from another, the order inside it, and how windows over it are laid out.

Every windowed operator takes a DataFrame and a Series and uses the same partition and order, so that Catalyst plans
one exchange and one sort for a whole stack of them. Series are told apart by `keys`; `order` must be total (put a tie
breaker last).

A series can hold a large share of all rows. `bounded()` runs an operator whose rows look back over at most `halo` rows
on chunks of a series, each with the halo of rows before it; `running_sum()` adds up in two levels. Both give what one
window over the whole series gives, without one task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one chunk of a series; series of fewer rows aren't cut. A Python worker holds a chunk and its results.
CHUNK_ROWS = 100_000


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self):
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int):
        """The row and the n - 1 before it."""
        return self.window.rowsBetween(1 - n, 0)

    @property
    def upto(self):
        """All rows up to this one."""
        return self.window.rowsBetween(W.unboundedPreceding, 0)

    @property
    def whole(self):
        return W.partitionBy(*self.keys)

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(c, k).over(self.window)

    def diff(self, c: str, k: int = 1) -> Column:
        return F.col(c) - self.lag(c, k)

    def full(self, c: Column | str, n: int, value: Column, min_periods: int | None = None) -> Column:
        """value (an aggregate) over the last n rows, null unless min_periods (n) of them have c."""
        w = self.last(n)
        return F.when(F.count(c).over(w) >= (n if min_periods is None else min_periods), value.over(w))

    def mean(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self.full(c, n, F.avg(c), min_periods)

    def std(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self.full(c, n, F.stddev_samp(c), min_periods)

    def sum(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self.full(c, n, F.sum(c), min_periods)

    def min(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self.full(c, n, F.min(c), min_periods)

    def max(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self.full(c, n, F.max(c), min_periods)

    def values(self, c: Column | str, n: int) -> Column:
        """The non-null values of the last n rows in order, null unless there are n."""
        return self.full(c, n, F.collect_list(c))

    def with_key(self, name: str) -> Series:
        return replace(self, keys=(*self.keys, name))


def _same(a: list[str], suffix: str) -> Column:
    out = F.lit(True)
    for k in a:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return out


def default_bucket(df: DataFrame, s: Series) -> Column:
    """Parts of a series in order: days of a time, spans of 100,000 of a number."""
    kind = dict(df.dtypes)[s.order[0]]
    return F.to_date(s.order[0]) if kind.startswith(("timestamp", "date")) else F.floor(F.col(s.order[0]) / 100_000)


def row_numbers(df: DataFrame, s: Series, bucket: Column | None = None) -> DataFrame:
    """df with _rn, the number (from 0) of a row in its series; `bucket` parts a series in order, without ties across.

    Rows are numbered inside (series, bucket) and shifted by the rows of earlier buckets: only the table of bucket
    sizes sees a window over a whole series. Without a bucket default_bucket() parts it.
    """
    bucket = default_bucket(df, s) if bucket is None else bucket
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*s.keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*s.keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"{k}__") for k in s.keys], F.col("_bucket").alias("_bucket__"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(s.with_key("_bucket").window) - 1)
    rows = rows.join(sizes, _same([*s.keys, "_bucket"], "__"))
    return rows.withColumn("_rn", F.col("_before") + F.col("_in")).select(*df.columns, "_rn")


def largest(df: DataFrame, s: Series) -> int:
    """Rows of the longest series."""
    return df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def bounded(df: DataFrame, s: Series, halo: int, operator: Callable[[DataFrame, Series], DataFrame], chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, longest: int | None = None) -> DataFrame:
    """operator(df, s) for an operator that looks back over at most `halo` rows, in chunks if a series is long.

    longest is largest(df, s), for callers that stack several operators: the source is counted once then.
    Smoothing with decay looks back without end, but what lies before the halo weighs less than a double can hold when
    halo is large enough (recursive.py states how large).
    """
    if (largest(df, s) if longest is None else longest) <= chunk_rows:
        return operator(df, s)
    rows = row_numbers(df, s, bucket).withColumn("_chunk", F.expr(f"_rn div {chunk_rows}"))
    late = F.col("_rn") % chunk_rows >= chunk_rows - halo
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_halo", F.explode(copies)).withColumn("_chunk", F.col("_chunk") + F.col("_halo"))
    return operator(rows, s.with_key("_chunk")).where("_halo = 0").drop("_rn", "_chunk", "_halo")


def running_sum(df: DataFrame, s: Series, sums: dict[str, Column], chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, longest: int | None = None) -> DataFrame:
    """df with sums from the first row of a series up to each row; a null adds nothing and is null in its own row."""
    rows = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    own = {k: F.when(F.col(f"_v_{k}").isNotNull(), F.sum(f"_v_{k}").over(s.upto)) for k in sums}
    if (largest(df, s) if longest is None else longest) <= chunk_rows:
        return rows.withColumns(own).drop(*(f"_v_{k}" for k in sums))
    rows = rows.withColumn("_bucket", default_bucket(df, s) if bucket is None else bucket)
    part = rows.groupBy(*s.keys, "_bucket").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    run = W.partitionBy(*s.keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*[F.col(k).alias(f"{k}__") for k in s.keys], F.col("_bucket").alias("_bucket__"), *[F.coalesce(F.sum(f"_s_{k}").over(run), F.lit(0.0)).alias(f"_b_{k}") for k in sums])
    inside = s.with_key("_bucket").upto
    rows = rows.join(part, _same([*s.keys, "_bucket"], "__"))
    out = rows.withColumns({k: F.when(F.col(f"_v_{k}").isNotNull(), F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(inside)) for k in sums})
    return out.select(*df.columns, *sums)


def carry_forward(df: DataFrame, s: Series, columns: dict[str, Column], chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None, longest: int | None = None) -> DataFrame:
    """df with the last non-null value of each column up to each row (forward fill), in two levels like running_sum()."""
    rows = df.withColumns({f"_v_{k}": v for k, v in columns.items()})
    if (largest(df, s) if longest is None else longest) <= chunk_rows:
        return rows.withColumns({k: F.last(f"_v_{k}", True).over(s.upto) for k in columns}).drop(*(f"_v_{k}" for k in columns))
    rows = rows.withColumn("_bucket", default_bucket(df, s) if bucket is None else bucket)
    at = F.struct(*s.order)
    part = rows.groupBy(*s.keys, "_bucket").agg(*[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(f"_s_{k}") for k in columns])
    run = W.partitionBy(*s.keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*[F.col(k).alias(f"{k}__") for k in s.keys], F.col("_bucket").alias("_bucket__"), *[F.last(f"_s_{k}", True).over(run).alias(f"_b_{k}") for k in columns])
    inside = s.with_key("_bucket").upto
    rows = rows.join(part, _same([*s.keys, "_bucket"], "__"))
    out = rows.withColumns({k: F.coalesce(F.last(f"_v_{k}", True).over(inside), f"_b_{k}") for k in columns})
    return out.select(*[c for c in df.columns if c not in columns], *columns)
