"""Input views of the sample tables, and the same views as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import Series

#: Results are rounded to so many digits, with a nudge off exact halves, so that two engines' last bits don't show.
DIGITS, NUDGE = 4, 1e-9
POINTS = Series(("series",), ("ts", "event_id"))
BARS = Series(("symbol",), ("bar",))
DAYS = Series(("series",), ("day",))
HOUR = 3_600_000_000


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = Query(f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored; times are read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series by type: (series, ts, event_id, value)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by event type, with quantity 1 + user_id % 10; even users buy."""
    e = table(spark, sf_dir, "events")
    at, v, q = F.struct("ts", "event_id"), F.col("value"), (1 + F.col("user_id") % 10)
    buy = F.when(F.col("user_id") % 2 == 0, q).otherwise(0)
    g = e.groupBy(F.col("event_type").alias("symbol"), F.expr(f"unix_micros(cast(ts as timestamp)) div {HOUR}").alias("bar"))
    return g.agg(
        F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), F.sum(q).cast("double").alias("volume"),
        F.sum(buy).cast("double").alias("buy_volume"), F.sum(q - buy).cast("double").alias("sell_volume"),
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and day: value (total price) and reference (their number)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 86400000000").alias("day"), "o_totalprice")
    return o.groupBy("series", "day").agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).cast("double").alias("reference"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as order books by brand: odd sizes bid, even ones ask."""
    p = table(spark, sf_dir, "part")
    side = F.when(F.col("p_size") % 2 == 1, "bid").otherwise("ask")
    return p.select(F.col("p_brand").alias("block"), side.alias("side"), F.col("p_partkey").alias("tie"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("quantity"), (F.col("p_retailprice") * F.col("p_size")).alias("notional"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades by user block: purchases buy, errors sell, others bid or ask by user."""
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell").when(F.col("user_id") % 2 == 0, "bid").otherwise("ask")
    q = 1 + F.col("user_id") % 10
    age = (F.expr("1706659200000000") - micros()) / 1_000_000
    return e.select((F.col("user_id") % 8).alias("block"), "event_id", "ts", side.alias("side"), F.col("value").alias("price"), q.cast("double").alias("quantity"), (F.col("value") * q).alias("notional"), age.alias("age_seconds"), (age / 2).alias("active_duration_seconds"))


POINTS_SQL = "points AS (SELECT event_type AS series, ts, event_id, value FROM events)"
BARS_SQL = f"""bars AS (
  SELECT event_type AS symbol, epoch_us(ts) // {HOUR} AS bar, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
         sum(1 + user_id % 10)::DOUBLE AS volume, sum(CASE WHEN user_id % 2 = 0 THEN 1 + user_id % 10 ELSE 0 END)::DOUBLE AS buy_volume,
         sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 + user_id % 10 END)::DOUBLE AS sell_volume
  FROM events GROUP BY 1, 2)"""
DAYS_SQL = """days AS (
  SELECT o_orderpriority AS series, epoch_us(o_orderdate) // 86400000000 AS day, sum(o_totalprice) AS value, count(*)::DOUBLE AS reference FROM orders GROUP BY 1, 2)"""
BOOK_SQL = """book AS (
  SELECT p_brand AS block, CASE WHEN p_size % 2 = 1 THEN 'bid' ELSE 'ask' END AS side, p_partkey AS tie, p_retailprice AS price, p_size::DOUBLE AS quantity, p_retailprice * p_size AS notional FROM part)"""
TRADES_SQL = """trades AS (
  SELECT user_id % 8 AS block, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'error' THEN 'sell' WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, value AS price,
         (1 + user_id % 10)::DOUBLE AS quantity, value * (1 + user_id % 10) AS notional, (1706659200000000 - epoch_us(ts)) / 1000000.0 AS age_seconds, (1706659200000000 - epoch_us(ts)) / 2000000.0 AS active_duration_seconds FROM events)"""


# --- results -----------------------------------------------------------------------------------------------


def finish(df: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep (all, if none are named), doubles rounded so that engines agree."""
    keep = keep or tuple(df.columns)
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c) + NUDGE, DIGITS).alias(c) if kinds[c] in {"double", "float"} else F.col(c) for c in keep])


def r(x: str) -> str:
    """SQL: rounded, without a negative zero."""
    return f"round(({x}) + {NUDGE}, {DIGITS}) + 0.0"


def rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"{r(x)} AS {name}" for name, x in columns.items())


class Sql:
    """Window phrases over one series in SQL."""

    def __init__(self, keys: str, order: str):
        self.over = f"PARTITION BY {keys} ORDER BY {order}"

    def w(self, n: int) -> str:
        return f"OVER ({self.over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    @property
    def upto(self) -> str:
        return f"OVER ({self.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER ({self.over})"

    def full(self, x: str, n: int, agg: str, least: int | None = None) -> str:
        return f"CASE WHEN count({x}) {self.w(n)} >= {least or n} THEN {agg} {self.w(n)} END"

    def avg(self, x: str, n: int) -> str:
        return self.full(x, n, f"avg({x})")

    def std(self, x: str, n: int) -> str:
        return self.full(x, n, f"stddev_samp({x})")

    def max(self, x: str, n: int) -> str:
        return self.full(x, n, f"max({x})")

    def min(self, x: str, n: int) -> str:
        return self.full(x, n, f"min({x})")

    def sum(self, x: str, n: int) -> str:
        return self.full(x, n, f"sum({x})")

    def rn(self) -> str:
        return f"row_number() OVER ({self.over}) - 1"

    def ewm(self, x: str, alpha: float, first: int = 0) -> str:
        """Exponential average of x, which is null before row `first` and nowhere after; needs a column rn."""
        a, b = repr(alpha), repr(1 - alpha)
        term = f"(CASE WHEN rn = {first} THEN {x} WHEN rn > {first} THEN {a} * ({x}) END) * pow({b}, {first} - rn)"
        return f"CASE WHEN rn >= {first} THEN pow({b}, rn - {first}) * sum({term}) {self.upto} END"


S_POINTS = Sql("series", "ts, event_id")
S_BARS = Sql("symbol", "bar")
S_DAYS = Sql("series", "day")
