"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, in DataFrame operations only.

Each row gets an exponential key -ln(u) / w, where u in (0, 1) comes from the MD5 of its doc_id and w is its
quality weight: the smallest keys of a source come first, so heavier rows come earlier. Rows are taken in key order
until their source's budget is full; whole epochs of the source come before that fraction.

A running sum over a source would put a hot source into one task. So the key's range is cut into buckets of about as
many rows each (place() makes keys near uniform, whatever the weights are), sums by (source, bucket) are made first, running sums over those few rows give each
bucket its start, and rows are then summed inside (source, bucket). The number of buckets follows the number of rows.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null doc_id draws as
the text 'null'; a null, zero or negative weight counts as 1; rows that repeat a doc_id share a key and are told apart
by size alone (rows equal in all of these are interchangeable); an empty table gives an empty result; a source whose
texts have no words gets target 0. Columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_keys, word_count

#: Rows that one (source, bucket) window holds, about.
BUCKET_ROWS = 50_000
SHARES = (5, 2, 1)


def targets(sizes: DataFrame, total_share: float = 1.5, ceiling: float = 2.0, shares: tuple = SHARES) -> DataFrame:
    """(source, source_size) -> target words of each source: water-filling under a ceiling.

    Sources, by code point with null last, weigh `shares` over and over and divide total_share of all words;
    whatever lies above ceiling times a source's own size is shared again by weight. In closed form: with sources
    sorted by cap / weight, those are capped whose cap / weight is at most the level that the rest would get.
    The two windows without keys run over one row a source.
    """
    everything = W.partitionBy()
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (n % len(shares) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"))
    s = s.select("*", (F.col("source_size") * F.lit(float(ceiling))).alias("cap"))
    s = s.select("*", (F.sum("source_size").over(everything) * F.lit(float(total_share))).alias("all_words"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.select("*", ((F.col("all_words") - before) / rest).alias("level"))
    s = s.select("*", (F.col("cap") / F.col("w") <= F.col("level")).alias("capped"))
    s = s.select("*", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything).alias("open_level"))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("w")).alias("target"))


def draw(doc_id: Column, weight: Column) -> Column:
    """The exponential key of a row; the same in every run."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / _sound(weight)


def _sound(weight: Column) -> Column:
    return F.when(weight > 0, weight).otherwise(1.0)


def place(rows: DataFrame, key: Column, weight: Column) -> Column:
    """A number from 0 to 1 that grows with the key, near uniform over rows: their share with a smaller key, about.

    Keys of weight w are exponential at rate w; weights count by powers of two (at most 65 of them reach the driver).
    """
    power = F.greatest(F.lit(-32.0), F.least(F.lit(32.0), F.round(F.log2(_sound(weight)))))
    found = rows.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in found)
    parts = [F.lit(r["n"] / total) * (1 - F.exp(F.lit(-(2.0 ** r["p"])) * key)) for r in found if r["p"] is not None]
    return sum(parts[1:], parts[0]) if parts else 1 - F.exp(-key)


def mix(docs: DataFrame, weight: str | None = None, size: str | None = None, total_share: float = 1.5, ceiling: float = 2.0, shares: tuple = SHARES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, source and text or a size column, more if wanted) with size, source_size, target, epochs, taken.

    taken is the number of words the mix takes of the row: epochs times its size, and in the fractional epoch its
    size, or as many of its first words as the budget still holds, or nothing.
    """
    own = [c for c in docs.columns if c not in {"size", "source_size", "target", "epochs", "taken"}]
    words = (F.coalesce(F.col(size), F.lit(0)) if size else word_count(F.col("text"))).cast("long")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = docs.select(*own, words.alias("__sm_size"), draw(F.col("doc_id"), w).alias("__sm_key")).withColumnRenamed("__sm_size", "size")
    buckets = max(1, math.ceil(docs.count() / bucket_rows))
    at = place(docs, F.col("__sm_key"), w) if weight and buckets > 1 else 1 - F.exp(-F.col("__sm_key"))
    rows = rows.withColumn("__sm_bucket", F.least(F.floor(at * buckets), F.lit(buckets - 1)).cast("int"))
    part = rows.groupBy("source", "__sm_bucket").agg(F.sum("size").alias("__sm_sum"))
    t = targets(part.groupBy("source").agg(F.sum("__sm_sum").alias("source_size")), total_share, ceiling, shares)
    t = t.withColumnRenamed("source", "__sm_s")
    run = W.partitionBy("source").orderBy("__sm_bucket").rowsBetween(W.unboundedPreceding, -1)
    part = part.select("source", "__sm_bucket", F.coalesce(F.sum("__sm_sum").over(run), F.lit(0)).alias("__sm_start"))
    part = part.join(t, F.col("source").eqNullSafe(F.col("__sm_s"))).drop("__sm_s").withColumnsRenamed({"source": "__sm_s", "__sm_bucket": "__sm_b"})
    rows = rows.join(part, F.col("source").eqNullSafe(F.col("__sm_s")) & (F.col("__sm_bucket") == F.col("__sm_b"))).drop("__sm_s", "__sm_b")
    inside = W.partitionBy("source", "__sm_bucket").orderBy("__sm_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__sm_before", F.col("__sm_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("__sm_before"))))
    return rows.select(*own, "size", "source_size", "target", "epochs", "taken")


def _times() -> Column:
    """How often a row is taken: whole epochs, and once more when at least half of it is in the fractional one."""
    part = F.col("taken") - F.col("epochs") * F.col("size")
    return (F.col("epochs") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).cast("int")


def _exploded(rows: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    return rows.withColumn("__sm_times", times.cast("int")).where("__sm_times > 0").withColumn("__sm_n", F.explode(F.sequence(F.lit(1), F.col("__sm_times")))).select(*columns)


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, source, t1, t2, words) of docs: all that a mix has to move."""
    return docs.select("doc_id", "source", *text_keys(F.col("text")), word_count(F.col("text")).alias("words"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs as often as a mix of narrow(docs) takes them; texts are moved once.

    Rows equal in doc_id, source and text share what the mix takes of them evenly; one of them gets the rest.
    """
    names = {"doc_id": "__sm_d", "source": "__sm_s", "t1": "__sm_1", "t2": "__sm_2"}
    of = mixed.groupBy(*names).agg(F.sum(_times()).alias("__sm_sum"), F.count(F.lit(1)).alias("__sm_rows"))
    of = materialise(of.where("__sm_sum > 0").withColumnsRenamed(names), "mix-times")
    t1, t2 = text_keys(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__sm_d")) & F.col("source").eqNullSafe(F.col("__sm_s")) & (t1 == F.col("__sm_1")) & (t2 == F.col("__sm_2"))
    out = _exploded(docs.join(of, same), F.floor(F.col("__sm_sum") / F.col("__sm_rows")), docs.columns)
    uneven = of.where("__sm_sum % __sm_rows > 0")
    if uneven.isEmpty():
        return out
    one = docs.join(uneven, same).groupBy(*names.values(), "__sm_sum", "__sm_rows").agg(F.any_value(F.struct(*docs.columns)).alias("__sm_row"))
    return out.unionByName(_exploded(one, F.col("__sm_sum") % F.col("__sm_rows"), ["__sm_row.*"]))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: each document as often as it is taken, the cut one when at least half of it is."""
    return _exploded(mixed, _times(), columns)
