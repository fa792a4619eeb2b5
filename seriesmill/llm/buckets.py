"""Compare the members of buckets in bounded memory and report a spanning forest of the links, not all pairs.

Rows (bucket key, id, payload, home, ...) are dealt by key and sorted; a worker streams through its partition group by
group. Buckets above `limit` rows are first cut into chunks; each pair of chunks is one group, so that no task has to
hold a large bucket and every pair of rows still meets once. What a group reports is one link per id at most, so a
group of n close copies gives fewer than n links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids -> (id, least id of its component) for every id that isn't the least."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        was = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (was == label).all():
            break
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def split_hot(rows: DataFrame, limit: int, weight: Column | None = None, counted: int = 1) -> DataFrame:
    """rows (key, id, home, ...) with group columns (key, i, j): chunk pairs of hot buckets, (key, 0, 0) of others.

    The table of hot keys has at most rows / limit entries; it is joined, not broadcast by hand. Rows count 1 each, or
    their weight; one id in `counted` is counted, for all.
    """
    some = rows if counted == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(counted)) == 0)
    hot = some.groupBy("key").agg(((F.count(F.lit(1)) if weight is None else F.sum(weight)) * counted).alias("_n")).where(F.col("_n") > limit)
    hot = hot.select(F.col("key").alias("_k"), F.ceil(F.col("_n") / limit).cast("int").alias("_c"))
    rows = rows.join(hot, F.col("key") == F.col("_k"), "left").drop("_k").withColumn("_c", F.coalesce("_c", F.lit(1)))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_c")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return rows.select("*", F.least("_g", "_o").alias("i"), F.greatest("_g", "_o").alias("j")).drop("_o", "_c")


def groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1 << 18, room: int = 64 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; about `most` rows or `room` bytes each, or one larger group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most or sum(b.nbytes for b in held) >= room:
            t = pa.Table.from_batches(held).combine_chunks()
            start = last_start(t, by)
            if start:
                yield t.slice(0, start)
            held = t.slice(start).to_batches()
            n = t.num_rows - start
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(t: pa.Table, by: list[str]) -> np.ndarray:
    """Row numbers where a group begins."""
    change = np.ones(t.num_rows, dtype=bool)
    change[1:] = False
    for c in by:
        v = t[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def last_start(t: pa.Table, by: list[str]) -> int:
    return int(starts(t, by)[-1])


def bucket_links(rows: DataFrame, compare: Callable, limit: int = 2000, columns: tuple = (), counted: int = 1) -> DataFrame:
    """rows (key long, id long, ...) -> links (a, b): compare(table, starts) gives both ends as arrays for whole groups."""
    by = ["key", "i", "j"]
    rows = split_hot(rows, limit, counted=counted).select(*by, "_g", "id", *columns)

    def work(batches):
        for t in groups(batches, by):
            a, b = compare(t, np.append(starts(t, by), t.num_rows))
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(work, "a long, b long")
