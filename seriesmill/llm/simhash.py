"""SimHash near-duplicates: fingerprints of word shingles, linked through anchor points of covering codes.

Fingerprint: lower-case A-Z, words `[^\\x20\\x09-\\x0D]+`, shingles of `size` words with repeats, joined by a blank
(fewer words: the whole sequence); XXH64 with seed 42 of each; a bit is set if over half of the hashes set it.

Linking at `radius` 4: a fingerprint is cut into three blocks of 21, 21 and 22 bits. Two fingerprints within 4 bits
differ by at most 1 bit in block one, or at most 1 in block two, or not at all in block three (2 + 2 + 1 > 4). In each
block the anchors are the words of a covering code: a [15, 11] Hamming code on 15 of the bits, whose covering radius
is 1, and all values of the rest. A fingerprint's home is its nearest anchor; it is copied to every anchor within the
covering radius plus the block's threshold, so a partner's home is always among them. Per anchor, homes are compared
with the copies on all 64 bits. Equal fingerprints are one item from the start, so copies cost nothing here.

Similarity 0.8 (similar_documents): sets of five-word shingles have prints of 128 bits in two words, each word in three
blocks. Prints within 11 bits differ by at most 1 in one of the six blocks (6 * 2 > 11), so they meet at an anchor. Pairs
at 0.8 often differ in more bits than anchors can cover; those meet in MinHash bands, which are added to the method. What
meets is gathered in clusters, and there the exact Jaccard similarity of the sets decides, without a table of pairs.

Defined results: null and empty texts have fingerprint 0 and link like any other; rows that repeat a doc_id are all
kept; a null doc_id is never the least of a component unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links, forest, groups, split_hot, starts
from .common import drop, free, give_back, materialise, small_batches, text_keys, turn_to
from .components import connected_components

SHINGLE = 4
SEED = 42
#: (first bit, bits, threshold): the thresholds plus one add up to the radius plus one.
BLOCKS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
RADIUS = 4
HAMMING = 15
#: Blocks of the two words of the wide prints, and how many of the 128 bits may differ in a pair that an anchor brings
#: together: prints of unrelated texts that share a block's anchor are hardly ever so close.
WIDE_BLOCKS, ANCHOR_RADIUS = (((0, 21, 1), (21, 21, 1), (42, 22, 1)),) * 2, 28
#: At similarity 0.8 19 of the 128 bits differ in the mean (spread 4; 24 for sets of five); beyond, nothing is verified.
WIDE_RADIUS, WIDE_SHINGLE = 44, 5
BAND_ROWS, BANDS = 4, 32
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(13)
_MUL = _RNG.integers(1, 1 << 63, BAND_ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BAND_ROWS * BANDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 15
#: Shingles that weigh as much as one more row where sets are dealt out, and pairs of rows that are compared at a time.
_SHINGLES, _PAIRS = 512, 1 << 16
#: Of the rows of anchors one in so many is counted to tell which anchors are hot.
_COUNTED = 16


def text_key() -> Column:
    """128 bits of hashes that stand for a text."""
    return F.struct(*text_keys(F.col("text")))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included; no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    h, seed = xxhash.xxh64_intdigest, SEED
    n = len(words)
    if n <= size:
        return np.array([h(flat, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    begins = [0, *(e + 1 for e in ends[: n - size])]
    return np.fromiter((h(flat[s:e], seed) for s, e in zip(begins, ends[size - 1 :])), np.uint64, n - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of the bits as a signed 64-bit integer; no hashes: 0."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[k : k + _CHUNK]).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, fp long); text_key stands for the text, for joining back."""
    small_batches(docs.sparkSession)

    def work(batches):
        turn_to("simhash")
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), size)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(work, f"doc_id {kind}, text_key struct<t1:bigint,t2:bigint>, fp long")


def _patterns(most: int, n: int = HAMMING) -> list[np.ndarray]:
    """For each syndrome: the flips of at most `most` bits that turn a word with it into a code word."""
    out: list[list[int]] = [[] for _ in range(n + 1)]
    for k in range(most + 1):
        for places in itertools.combinations(range(1, n + 1), k):
            s = 0
            for p in places:
                s ^= p
            out[s].append(sum(1 << (p - 1) for p in places))
    return [np.array(x, np.uint64) for x in out]


def _syndromes(n: int = HAMMING) -> np.ndarray:
    table = np.zeros(1 << n, np.uint8)
    for p in range(1, n + 1):
        table ^= np.where((np.arange(1 << n) >> (p - 1)) & 1, p, 0).astype(np.uint8)
    return table


def anchors(fps: np.ndarray, blocks: tuple = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket key, index into fps, home) for every anchor that a fingerprint goes to."""
    u, table = fps.view(np.uint64), _syndromes()
    keys, index, home = [], [], []
    for number, (first, bits, threshold) in enumerate(blocks):
        block = (u >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        code, rest = block & np.uint64((1 << HAMMING) - 1), block >> np.uint64(HAMMING)
        syndrome = table[code.astype(np.int64)]
        for flips in range(0, threshold + 2):  # in the bits outside the code
            near = _patterns(1 + threshold - flips)
            for places in itertools.combinations(range(bits - HAMMING), flips):
                away = rest ^ np.uint64(sum(1 << p for p in places))
                for s in range(HAMMING + 1):
                    mine = np.flatnonzero(syndrome == s)
                    for flip in near[s] if len(mine) else ():
                        keys.append(np.uint64(number << 40) | (away[mine] << np.uint64(HAMMING)) | (code[mine] ^ flip))
                        index.append(mine)
                        weight = int(flip).bit_count()
                        home.append(np.full(len(mine), flips == 0 and weight == (s > 0)))
    return np.concatenate(keys).view(np.int64), np.concatenate(index), np.concatenate(home)


def _compare(t: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fp, home, side = t["id"].to_numpy(), t["home"].to_numpy(), t["_g"].to_numpy()
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    left, right, held = [], [], 0
    u = fp.view(np.uint64)
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        homes = s + np.flatnonzero(home[s:e])
        step = max(1, (1 << 18) // (e - s))
        for k in range(0, len(homes), step):
            h = homes[k : k + step]
            close = np.bitwise_count(u[h][:, None] ^ u[s:e][None, :]) <= RADIUS
            x, y = np.nonzero(close)
            x, y = h[x], s + y
            keep = fp[x] != fp[y]
            if i[s] != j[s]:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            if len(x):
                left.append(fp[x])
                right.append(fp[y])
                held += len(x)
            if held > 1 << 18:  # a large group of close prints: keep a forest of its links only
                a, b = forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(fps: DataFrame, limit: int = 2000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within the radius."""

    def spread(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                key, index, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[index]), pa.array(home)], ["key", "id", "home"])

    rows = fps.select("fp").mapInArrow(spread, "key long, id long, home boolean")
    return _found(rows, _compare, limit, ("home",))


def _found(rows: DataFrame, compare, limit: int, columns: tuple, counted: int = 1) -> DataFrame:
    """The links among anchored rows, as a table; the rows' own table, which is far larger, goes."""
    rows = materialise(rows, "anchors")
    links = materialise(bucket_links(rows, compare, limit, columns, counted), "found-links")
    drop(rows)
    return links


def minhash_bands(hashes: np.ndarray) -> np.ndarray:
    """Band keys (int64) of a set of shingle hashes; of the empty set: none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        v = (hashes[None, k : k + 2048] ^ _ADD[:, None]) * _MUL[:, None]
        v ^= v >> np.uint64(29)
        v *= _MIX
        np.minimum(least, v.min(axis=1), out=least)
    least = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _MIX
    for r in range(BAND_ROWS):
        key = (key ^ least[:, r]) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def wide_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, fp, n, low, high, bands) of the sets of shingles.

    fp is a hash of the whole set of n shingles, low and high are its 128-bit print, bands its MinHash band keys.
    """
    small_batches(docs.sparkSession)

    def work(batches):
        turn_to("simhash")
        for b in batches:
            fp, n, low, high, bands = [], [], [], [], []
            for t in b.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), size))
                fp.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                n.append(len(h))
                low.append(fingerprint(h))
                high.append(fingerprint(second_word(h)))
                bands.append(minhash_bands(h))
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), listed], ["doc_id", "text_key", "fp", "n", "low", "high", "bands"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, text_key struct<t1:bigint,t2:bigint>, fp long, n int, low long, high long, bands array<long>")


def second_word(hashes: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of each shingle, mixed from the first."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _homes(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the anchor of a row is the code word next to its print's own block, of which there is just one."""
    out = np.zeros(len(key), bool)
    for word, blocks in enumerate(WIDE_BLOCKS):
        for number, (first, bits, _) in enumerate(blocks):
            mine = np.flatnonzero(key >> 40 == (word << 4) + number)
            block = ((low, high)[word][mine] >> np.uint64(first)) & np.uint64((1 << bits) - 1)
            away = block ^ (key[mine].view(np.uint64) & np.uint64((1 << bits) - 1))
            out[mine] = (away >> np.uint64(HAMMING) == 0) & (np.bitwise_count(away) <= 1)
    return out


def _near(radius: int, anchored: bool):
    """A compare function for bucket_links(): rows (homes only, if anchored) against all rows within radius bits."""

    def compare(t: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, side, i, j = (t[c].to_numpy() for c in ("id", "_g", "i", "j"))
        low, high = ids.view(np.uint64), t["high"].to_numpy().view(np.uint64)
        home = np.flatnonzero(_homes(t["key"].to_numpy(), low, high)) if anchored else np.arange(t.num_rows)
        group = np.searchsorted(bounds, home, "right") - 1
        first, size = bounds[group], np.diff(bounds)[group]
        ends, at = np.cumsum(size), 0
        left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(home):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + _PAIRS, "right")))
            some = size[at:stop]
            x = np.repeat(home[at:stop], some)
            y = np.arange(len(x)) + np.repeat(first[at:stop] - (np.cumsum(some) - some), some)
            close = np.flatnonzero((np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= radius) & (ids[x] != ids[y]))
            x, y = x[close], y[close]
            keep = (i[x] == j[x]) | (side[x] != side[y])
            left.append(ids[x[keep]])
            right.append(ids[y[keep]])
            held += int(keep.sum())
            if held > 1 << 18:  # a large group of close prints: keep a forest of its links only
                a, b = forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
            at = stop
        return np.concatenate(left), np.concatenate(right)

    return compare


def anchored_pairs(items: DataFrame, limit: int = 2000) -> DataFrame:
    """Prints (low, high) -> links (a, b) of low words that connect what meets at an anchor within ANCHOR_RADIUS bits.

    No pair within 11 bits is missed.
    """

    def spread(batches):
        for b in batches:
            low, high = (b.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            for k in range(0, len(low), 1024):
                for word, blocks in enumerate(WIDE_BLOCKS):
                    key, index, _ = anchors((low, high)[word][k : k + 1024], blocks)
                    index = index + k
                    yield pa.RecordBatch.from_arrays([pa.array(key + (word << 44)), pa.array(low[index]), pa.array(high[index])], ["key", "id", "high"])
        give_back()

    rows = items.select("low", "high").mapInArrow(spread, "key long, id long, high long")
    return _found(rows, _near(ANCHOR_RADIUS, True), limit, ("high",), min(_COUNTED, max(1, limit // 100)))


def banded_pairs(items: DataFrame, limit: int = 2000) -> DataFrame:
    """Prints (low, high, bands) -> links (a, b) of low words that connect what shares a band within WIDE_RADIUS bits."""
    rows = items.select(F.explode("bands").alias("key"), F.col("low").alias("id"), "high")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    return _found(rows.join(shared, "key", "left_semi"), _near(WIDE_RADIUS, False), limit, ("high",))


def _alike(t: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of similarity 0.8 or more in each group, by the sets of shingles themselves.

    A row is compared with those behind it that aren't linked with it yet.
    """
    ids, side, n, i, j = (t[c].to_numpy() for c in ("id", "_g", "n", "i", "j"))
    low, high = t["low"].to_numpy().view(np.uint64), t["high"].to_numpy().view(np.uint64)
    sets = t["s"].combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    cut, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
    left, right = [], []
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        code = np.unique(values[cut[s] : cut[e]], return_inverse=True)[1]
        start, size = cut[s:e] - cut[s], np.diff(cut[s : e + 1])
        mark, label = np.zeros(len(code), bool), np.arange(e - s)
        for x in range(e - s - 1):
            rest = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
            a, b = s + x, s + rest
            far = np.bitwise_count(low[a] ^ low[b]) + np.bitwise_count(high[a] ^ high[b])
            fits = (far <= WIDE_RADIUS) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & ((i[a] == j[a]) | (side[a] != side[b]))
            y = rest[fits]
            if not len(y):
                continue
            mine, many = code[start[x] : start[x] + size[x]], size[y]
            before = np.cumsum(many) - many
            mark[mine] = True
            shared = np.add.reduceat(mark[code[np.arange(many.sum()) + np.repeat(start[y] - before, many)]], before, dtype=np.int64)
            mark[mine] = False
            y = y[9 * shared >= 4 * (size[x] + many)]
            if len(y):
                joined, one = np.unique(label[y], return_index=True)
                left.append(np.full(len(one), ids[a]))
                right.append(ids[s + y[one]])
                label[np.isin(label, joined)] = label[x]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _verified(clusters: DataFrame, items: DataFrame, docs: DataFrame, size: int, limit: int) -> DataFrame:
    """clusters (node, component) of low words -> links (a, b) that connect all pairs of similarity 0.8 or more in a cluster.

    Each set goes to its cluster once (to each pair of chunks of a large cluster), and links come out, not pairs.
    """
    wanted = items.join(clusters, items["low"] == clusters["node"], "left").select(F.coalesce("component", "low").alias("key"), F.col("fp").alias("id"), "n", "low", "high", F.col("least_text").alias("_t"))
    several = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    wanted = materialise(wanted.join(several, "key", "left_semi"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = wanted.select("id", "_t")
    text = docs.select(text_key().alias("text_key"), "text").join(F.broadcast(texts) if few else texts, F.col("text_key") == F.col("_t"))

    def sets(batches):
        for b in batches:
            s = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in b.column("text")]
            ends = np.cumsum([0, *map(len, s)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *s])))], ["id", "s"])

    # Copies of a text give the same set; one row of it goes on.
    s = text.select("id", "text").mapInArrow(sets, "id long, s array<long>").groupBy("id").agg(F.any_value("s").alias("s"))
    by = ["key", "i", "j"]
    rows = split_hot(wanted.drop("_t"), limit, 1 + F.col("n") / _SHINGLES).select(*by, "_g", "id", "n", "low", "high").join(s, "id")

    def work(batches):
        for t in groups(batches, by):
            a, b = _alike(t, np.append(starts(t, by), t.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    links = materialise(rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(work, "a long, b long"), "found-links")
    drop(wanted)
    return links


def wide_links(items: DataFrame, docs: DataFrame, size: int = WIDE_SHINGLE, limit: int = 2000) -> DataFrame:
    """Distinct (fp, n, low, high, bands, least_text) -> links (a, b) that connect all pairs of similarity 0.8 or more.

    A pair of similarity 0.8 shares none of the bands with probability (1 - 0.8 ** BAND_ROWS) ** BANDS, under 1e-7. What
    meets at an anchor or in a band is connected to clusters, and all pairs of a cluster within WIDE_RADIUS are verified.
    """
    met = anchored_pairs(items, limit), banded_pairs(items, limit)
    free(items.sparkSession)
    clusters = connected_components(met[0].union(met[1]))
    links = _verified(clusters, items, docs, size, limit)
    for x in met:
        drop(x)
    return links


def similar_documents(docs: DataFrame, size: int = WIDE_SHINGLE, limit: int = 2000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, fp, component_id, component): classes of shingle similarity 0.8 or more.

    Shingles of five words by default; a class is what pairs with an exact Jaccard similarity of 0.8 or more connect.
    """
    prints = materialise(wide_fingerprints(docs, size), "fingerprints")
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("least_text"), *[F.min(c).alias(c) for c in ("n", "low", "high", "bands")])
    one = materialise(one, "items")
    return _classes(prints, one, wide_links(one, docs, size, limit))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, limit: int = 2000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, fp, component_id, component): one row per row of docs.

    component_id is the least doc_id of a component, which others can share (null or repeated ids); component is its own.
    """
    prints = materialise(fingerprints(docs, size), "fingerprints")
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return _classes(prints, one, fingerprint_links(one, limit))


def _classes(prints: DataFrame, one: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    one = one.join(parts, one["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = one.groupBy("component").agg(F.min("least").alias("component_id"))
    one = one.join(of, "component").select(F.col("fp").alias("_fp"), "component_id", "component")
    return prints.join(one, prints["fp"] == one["_fp"]).select("doc_id", "text_key", "fp", "component_id", "component")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of docs for each component: that with the least (doc_id, text_key), null ids last.

    Rows that repeat both id and text are one document and leave one row.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    best = classes.groupBy(F.col("component").alias("_c")).agg(F.min(rank).alias("_best"))
    marked = classes.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    marked = marked.join(best, F.col("component") == F.col("_c"))
    lead = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("text_key") == F.col("_best.text_key"))
    marked = materialise(marked.select(F.col("doc_id").alias("__sm_d"), F.col("text_key").alias("__sm_t"), lead.alias("lead"), "n").where("n > 1 or not lead"), "marked")
    same = F.col("doc_id").eqNullSafe(F.col("__sm_d")) & (text_key() == F.col("__sm_t"))
    kept = docs.join(marked.where("not lead"), same, "left_anti")
    twice = marked.where("lead")
    if not twice.isEmpty():
        once = kept.join(twice, same, "left_semi").withColumn("__sm_t", text_key()).dropDuplicates(["doc_id", "__sm_t"])
        kept = kept.join(twice, same, "left_anti").unionByName(once.drop("__sm_t"))
    return kept.select(*docs.columns)
