"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame operations only. Texts are lower-cased, cut at every run of characters that are neither letters nor digits,
and seen as shingles of five words (items of fewer words: one shingle of all of them).

1. Screen, without loss: a window whose weighted-shingle similarity to an item is above 0 shares a shingle with it. So
   every shingle of every document is looked up among the items' shingles, and each hit fixes where a window of the
   item's size would begin. Only those windows go on; a text without hits is never windowed.
   Windows with fewer hits in line than the similarity needs are left out at once, which loses none that reach it.
   The items that a window can match are those of which it holds one of the rarest shingles: at least `similarity` of
   an item's n shingles must be there, m of them, so one of any n - m + 1 is. No shingle that many items share makes
   pairs.
2. Every such window (as many words as the item) gets a 64-bit SimHash of its shingles, repeats included.
3. Multi-index: fingerprints are cut into radius + 1 blocks; two within the radius agree on at least one. Windows join
   those items on (item, block, value), and a pair counts at the first block on which it agrees. (At similarity 0.8
   blocks have three or four bits, so alone they would tell few windows and items apart.)
4. The candidates within the radius are verified: sum of least over sum of greatest shingle weights, weights being
   multiplicities, at least `similarity`.

For similarity 0.8 two windows differ in about 10 of 64 bits (spread 3); the default radius of 20 lies beyond three
spreads.

Defined results: null and empty texts, and texts or items without letters and digits, match nothing; a document shorter
than an item is compared as a whole; rows that repeat a doc_id are pooled in one result row per item; items equal in
text each match; null ids are ids like others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_keys

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Rows of the items' shingle table up to which it is sent to every executor (28 bytes a row); beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, as an array; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(w) - size)
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _sized(w: Column, sizes: list[int]) -> Column:
    """Map-like array of (k, shingles of k words) for the shingle sizes in use: five, and shorter items' sizes."""
    return F.array(*[F.named_struct(F.lit("k"), F.lit(k), F.lit("h"), shingles(w, k)) for k in sizes])


def simhash(name: str) -> Column:
    """Majority of the bits of the hashes in array column `name`, as one expression."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, j) -> f | if(aggregate({name}, 0L, (c, h) -> c + (shiftrightunsigned(h, j) & 1L)) * 2 > size({name}), shiftleft(1L, j), 0L))")


def block_values(fp: Column, radius: int) -> Column:
    """(block, value) of the radius + 1 blocks of a fingerprint."""
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    parts = [F.named_struct(F.lit("block"), F.lit(b), F.lit("value"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return F.array(*parts)


def first_common(a: Column, b: Column, radius: int) -> Column:
    """The first block on which two fingerprints agree."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    x = a.bitwiseXOR(b)
    out = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        mask = ((1 << (hi - lo)) - 1) << lo
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        out = F.when(x.bitwiseAND(F.lit(mask)) == 0, F.lit(k)).otherwise(out)
    return out


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of least over sum of greatest multiplicities of two arrays of hashes."""
    count = "size(filter({x}, y -> y = s))"
    least = f"aggregate(array_intersect({a}, {b}), 0, (t, s) -> t + least({count.format(x=a)}, {count.format(x=b)}))"
    return F.expr(f"try_divide(cast({least} as double), size({a}) + size({b}) - {least})")


def text_id(text: Column) -> Column:
    """128 bits of hashes that stand for a text."""
    return F.struct(*text_keys(text))


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, item_id, similarity, first_word, words, windows)."""
    pairs = matching_windows(docs, items, radius, similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length"))
    out = pairs.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count(F.lit(1)).alias("windows"))
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"), F.col("best.length").alias("words"), "windows")


def candidates(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, list[int]]:
    """docs, items -> items with their shingles, windows with the items that they can match, and the shingle sizes in use."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", F.size("w").alias("length"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    by_size = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        by_size = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(by_size)
    listed = w.select(F.monotonically_increasing_id().alias("item"), "item_id", "length", "k", by_size.alias("item_h"))
    listed = materialise(listed.withColumn("item_fp", simhash("item_h")), "items")
    sizes = sorted({SHINGLE, *(r["k"] for r in listed.select("k").distinct().collect())})  # at most five numbers

    # A window that reaches the similarity holds `similarity` of the item's shingles, and each break in how it lines up
    # with the item costs at least SHINGLE - 1 of those that may be missing: so one alignment has this many hits.
    of_item = F.col("length") - F.col("k") + 1
    least = F.floor(similarity * of_item / (1 + (1 - similarity) * of_item / (SHINGLE - 1)))
    placed = listed.select("item", "k", "length", F.posexplode("item_h").alias("off", "h"))
    starts = placed.select("k", "h", F.struct("off", "length").alias("at")).groupBy("k", "h").agg(F.collect_set("at").alias("ats"))
    starts = materialise(starts, "starts")
    bounded = starts.count() <= BROADCAST_ROWS
    held = placed.groupBy("k", "h").agg(F.count(F.lit(1)).alias("held"))
    rarest = placed.join(held, ["k", "h"]).withColumn("r", F.row_number().over(W.partitionBy("item").orderBy("held", "off")))
    rarest = materialise(rarest.where(F.col("r") <= of_item - F.ceil(similarity * of_item) + 1).select("item", "k", "length", "h").distinct(), "rarest")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    key = text_id(F.col("text"))
    seen = text.select(key.alias("key"), words(F.col("text")).alias("w"))
    if sizes == [SHINGLE]:
        seen = seen.select("key", F.size("w").alias("n"), F.lit(SHINGLE).alias("k"), F.posexplode(shingles(F.col("w"), SHINGLE)).alias("pos", "h"))
    else:
        seen = seen.select("key", F.size("w").alias("n"), F.explode(_sized(F.col("w"), sizes)).alias("s")).select("key", "n", "s.k", F.posexplode("s.h").alias("pos", "h"))
    hits = seen.join(F.broadcast(starts) if bounded else starts, ["k", "h"])
    hits = hits.select("key", "k", "h", "pos", "n", F.explode("ats").alias("at")).select("key", "k", "h", "n", (F.col("pos") - F.col("at.off")).alias("start"), F.col("at.length").alias("length"), F.col("at.off").alias("off"))
    hits = materialise(hits.distinct(), "hits")
    line = ["key", "k", "n", "start", "length"]
    whole = hits.groupBy(*line).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least).drop("votes")
    place = F.greatest(F.lit(0), F.least(F.col("start"), F.col("n") - F.col("length")))
    whole = whole.select("key", "k", place.alias("start"), "length").distinct()
    # Windows and rare shingles of one text meet in stretches of a window's length, of which a window touches two.
    whole = whole.withColumn("part", F.explode(F.array(F.floor(F.col("start") / F.col("length")), F.floor(F.col("start") / F.col("length")) + 1)))
    rare = hits.select("key", "k", "h", (F.col("start") + F.col("off")).alias("pos")).distinct().join(rarest, ["k", "h"])
    rare = rare.select("key", "k", "length", "item", "pos", F.floor(F.col("pos") / F.col("length")).alias("part"))
    mates = whole.join(rare, ["key", "k", "length", "part"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("start") + F.col("length") - F.col("k")))
    mates = mates.select("key", "k", "start", "length", "item").distinct()
    mates = materialise(mates, "window-items")
    return listed, mates, sizes


def matching_windows(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, items -> (doc_id, text_key, item_id, similarity, start, length) of every window that reaches the similarity."""
    listed, mates, sizes = candidates(docs, items, similarity)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    key = text_id(F.col("text"))
    windows = mates.select("key", "k", "start", "length").distinct().groupBy("key").agg(F.collect_list(F.struct("k", "start", "length")).alias("windows"))
    windows = materialise(windows.withColumnRenamed("key", "_key"), "windows")

    # One pass more over the texts, of which those with hits alone go on; no text is windowed twice.
    # Each step is written, so that no array is computed again for every window or bit.
    found = text.join(windows, key == F.col("_key")).select("doc_id", F.col("_key").alias("text_key"), words(F.col("text")).alias("w"), "windows")
    found = materialise(found, "found")
    found = materialise(found.select("doc_id", "text_key", _sized(F.col("w"), sizes).alias("s"), "windows"), "found-shingles")
    found = found.select("doc_id", "text_key", "s", F.explode("windows").alias("win"))
    all_h = F.expr("filter(s, x -> x.k = win.k)[0].h")
    found = found.select("doc_id", "text_key", F.col("win.start").alias("start"), F.col("win.length").alias("length"), F.slice(all_h, F.col("win.start") + 1, F.greatest(F.lit(1), F.col("win.length") - F.col("win.k") + 1)).alias("doc_h"))
    found = materialise(found, "found-windows")
    found = found.withColumn("fp", simhash("doc_h")).withColumn("b", F.explode(block_values(F.col("fp"), radius)))
    index = listed.select(F.col("item").alias("_item"), "item_id", "item_h", "item_fp", F.explode(block_values(F.col("item_fp"), radius)).alias("_b"))
    of = mates.select(F.col("key").alias("text_key"), "start", "length", "item")
    pairs = found.join(of, ["text_key", "start", "length"]).join(index, (F.col("item") == F.col("_item")) & (F.col("b.block") == F.col("_b.block")) & (F.col("b.value") == F.col("_b.value")))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (first_common(F.col("fp"), F.col("item_fp"), radius) == F.col("b.block"))
    pairs = pairs.where(near).withColumn("similarity", weighted_similarity("doc_h", "item_h")).where(F.col("similarity") >= similarity)
    return pairs.select("doc_id", "text_key", "item_id", "similarity", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose own text has a match; other rows of the same doc_id, null or not, stay."""
    bad = matching_windows(docs, items, radius, similarity).select(F.col("doc_id").alias("__sm_d"), F.col("text_key").alias("__sm_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__sm_d")) & (text_id(F.col("text")) == F.col("__sm_t"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
