"""Substring dedup: passages that repeat across documents, nearly by MinHash banding and exactly by shared windows.

A paragraph is a line that holds words. Lines are lower-cased (A-Z) and seen as sets of five-word shingles (fewer
words: the whole line is one). MinHash with ROWS hashes a band and BANDS bands: a pair of similarity 0.8 shares no
band with probability (1 - 0.8 ** ROWS) ** BANDS, under 0.0003 for 2 and 8. Lines that collide in a band are verified
by the exact Jaccard similarity of their shingle sets; links go through connected components, which give the classes
of paragraphs. A passage of paragraphs is the shortest run of neighbouring lines from some line on that has PASSAGE
words; it repeats if the same run of classes stands in two different texts. Lines of such runs are result rows.

A passage can also begin and end inside lines, or be broken over lines otherwise. So the words of every text are
winnowed as well, across line ends: of the hashes of all windows of WINDOW words the least of every SPREAD neighbours is
kept, which keeps at least one window of any run of PASSAGE = WINDOW + SPREAD - 1 = 51 equal words, wherever it stands.
Where a kept window stands in two texts, all windows of PASSAGE words around it are compared by two independent
64-bit hashes; those that stand in two texts are joined into stretches, which are the maximal repeated ones: every run
of PASSAGE or more equal words, to its last word, and nothing else. Stretches that share a window are one class, and
so are a stretch and the paragraphs of others that lie inside of it.

A text that several documents have is one whole passage of them (PASSAGE words or more).

removed marks what can be cut without losing anything: the words of windows (lines of passages, whole copies) that an
earlier document has as well. The order is that of doc_id, null last, then of the text's hashes; the first document of
each keeps them. A stretch is cut into rows where that changes.

Nothing is left out for being frequent: windows and lines travel as hashes and meet in aggregates and joins, line
buckets of any size are compared in bounded memory (buckets.py), and copies of a text are one item from the start.

Defined results: null and empty texts have no passages; rows that repeat doc_id and text are one document; rows of one
doc_id with different texts are different documents; what repeats inside one text alone isn't reported; an empty
table gives no rows; other columns are ignored. Texts are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links, groups, starts
from .common import drop, free, materialise, small_batches, text_keys
from .components import connected_components
from .flat import Words, chunks

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 2, 8
PASSAGE = 51
WINDOW, SPREAD = 40, 12
SEED = 42
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
TEXT = ["t1", "t2"]


def shingles(line: bytes) -> list[int]:
    """Hashes of the five-word shingles of a lower-cased line; no words: none."""
    words = line.split()
    if not words:
        return []
    flat, h = b" ".join(words), xxhash.xxh3_64_intdigest
    n = len(words)
    if n <= SHINGLE:
        return [h(flat)]
    ends = [e + i for i, e in enumerate(itertools.accumulate(map(len, words)))]
    begins = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    return [h(flat[s:e]) for s, e in zip(begins, ends[SHINGLE - 1 :])]


def bands(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys (int64) of the sets that begin at `at` in hashes."""
    if not len(at):
        return np.zeros((0, BANDS), np.int64)
    out = np.empty((len(at), ROWS * BANDS), np.uint64)
    x = hashes ^ (hashes >> np.uint64(31))
    for k in range(ROWS * BANDS):
        v = (x ^ _ADD[k]) * _MUL[k]
        v ^= v >> np.uint64(29)
        out[:, k] = np.minimum.reduceat(v * _MIX, at)
    out = out.reshape(len(at), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _MIX + np.zeros((len(at), 1), np.uint64)
    for r in range(ROWS):
        key = (key ^ out[:, :, r]) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def kept_windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the windows that winnowing keeps; windows stay inside their text."""
    last = w.first[w.text + 1]  # behind the text of each word
    at = np.arange(len(w.start))
    fits = at + WINDOW <= last
    v = np.full(len(at) + SPREAD, _FAR)
    v[at[fits]] = w.runs(at[fits], at[fits] + WINDOW)
    two = np.minimum(v[:-1], v[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[: len(at)], four[8 : 8 + len(at)])  # of each window and the SPREAD - 1 behind it
    whole = (at + WINDOW + SPREAD - 1 <= last) | ((at == w.first[w.text]) & fits)
    # A window is kept if it is the least of one of the groups that it stands in: the greatest of their least ones.
    m = np.zeros(len(at) + SPREAD - 1, np.uint64)
    m[SPREAD - 1 :][whole] = least[whole]
    two = np.maximum(m[:-1], m[1:])
    four = np.maximum(two[:-2], two[2:])
    eight = np.maximum(four[:-4], four[4:])
    best = np.maximum(eight[: len(at)], four[8 : 8 + len(at)])
    keep = np.flatnonzero(fits & (best == v[: len(at)]))
    return keep, v[keep].view(np.int64)


assert SPREAD == 12 and WINDOW + SPREAD - 1 == PASSAGE  # kept_windows() builds 12 from 8 and 4


def _listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values as lists of so many each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _line_columns(w: Words, raw: bytes, n: int) -> list[pa.Array]:
    """For each of n texts: lists of lines' begins, ends (code points of the text), words, keys, and all band keys."""
    newline = np.flatnonzero(w.data == 10)
    number = np.searchsorted(newline, w.start)
    new = np.ones(len(w.start), bool)
    new[1:] = (number[1:] != number[:-1]) | (w.text[1:] != w.text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(w.start)))
    text = w.text[head]
    edges = np.concatenate([[-1], newline, [len(w.data)]])
    start = np.maximum(edges[number[head]] + 1, w.begins[text])
    end = np.minimum(edges[number[head] + 1], w.ends[text])
    chars = w.characters()
    own = chars[w.begins[text]]
    keys = np.fromiter((xxhash.xxh64_intdigest(raw[s:e], SEED) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(head))
    count = np.maximum(size - SHINGLE + 1, 1)
    at = np.cumsum(count) - count
    first = np.arange(count.sum()) - np.repeat(at - head, count)
    found = bands(w.runs(first, np.minimum(first + SHINGLE, np.repeat(head + size, count))), at)
    lines = np.bincount(text, minlength=n)
    return [*(_listed(x, lines, pa.int32()) for x in (chars[start] - own, chars[end] - own, size)), _listed(keys.view(np.int64), lines, pa.int64()), _listed(found.ravel(), lines * BANDS, pa.int64())]


_PARSED = "t1 long, t2 long, n_words int, at array<int>, seed array<long>, start array<int>, end array<int>, size array<int>, line array<long>, bands array<long>"
_NAMES = [c.split()[0] for c in _PARSED.split(", ")]


def parsed(docs: DataFrame) -> DataFrame:
    """One row a text with words: its kept windows and its lines. Texts that a task has met it leaves out."""
    small_batches(docs.sparkSession)

    def work(batches):
        met: set[tuple[int, int]] = set()
        for b in batches:
            keys = list(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist()))
            new = [i for i, k in enumerate(keys) if k not in met and not met.add(k)]
            if len(met) > 1_000_000:
                met.clear()
            b = b.take(pa.array(new, pa.int64()))
            for first, stop, texts in chunks(b.column("text")):
                w = Words(texts)
                at, seed = kept_windows(w)
                text = w.text[at]
                kept = np.bincount(text, minlength=len(texts))
                cols = [pa.array(np.diff(w.first), pa.int32()), _listed(at - w.first[text], kept, pa.int32()), _listed(seed, kept, pa.int64()), *_line_columns(w, b"".join(texts), len(texts))]
                yield pa.RecordBatch.from_arrays([b.column("t1").slice(first, stop - first), b.column("t2").slice(first, stop - first), *cols], _NAMES)

    return _texts(docs).mapInArrow(work, _PARSED).where("n_words > 0")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(*text_keys(F.col("text")), "text")


def lines(texts: DataFrame) -> DataFrame:
    """parsed() -> (t1, t2, para, start, end, size, line): one row a line with words, again for texts parsed again."""
    rows = texts.select(*TEXT, F.posexplode(F.arrays_zip("start", "end", "size", "line")).alias("para", "x"))
    return rows.select(*TEXT, "para", "x.*")


def line_bands(texts: DataFrame) -> DataFrame:
    """parsed() -> (id, bands): different lines and their band keys."""
    rows = texts.select("bands", F.posexplode("line").alias("para", "id"))
    return rows.select("id", F.slice("bands", F.col("para") * BANDS + 1, BANDS).alias("bands")).groupBy("id").agg(F.any_value("bands").alias("bands"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two different texts, as a table: a join with it can be split where a key is frequent.

    Of texts with one key 64 bits tell any two apart.
    """
    found = rows.groupBy(key).agg(F.min("t1").alias("_a"), F.max("t1").alias("_b")).where("_a < _b").select(key)
    found = materialise(found, "shared")
    free(rows.sparkSession)
    return found


# --- exact stretches ---------------------------------------------------------------------------------------


def candidates(texts: DataFrame, leads: DataFrame) -> DataFrame:
    """Texts with a kept window that another text has: (ord, t1, t2, none, lead, n_docs, at); ord grows in document order."""
    seeds = texts.select(*TEXT, F.explode(F.arrays_zip("seed", "at")).alias("x")).select(*TEXT, "x.seed", "x.at")
    found = seeds.join(_shared(seeds, "seed"), "seed", "left_semi").groupBy(*TEXT).agg(F.sort_array(F.collect_set("at")).alias("at"))
    found = found.join(leads, TEXT).orderBy("none", "lead", *TEXT)
    return materialise(found.select(F.monotonically_increasing_id().alias("ord"), *TEXT, "none", "lead", "n_docs", "at"), "candidates")


def windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All windows of PASSAGE words that hold a shared kept window: (k1, k2, ord, pos, start, end)."""
    small_batches(docs.sparkSession)
    names = ["k1", "k2", "ord", "pos", "start", "end"]

    def work(batches):
        for b in batches:
            for first, stop, texts in chunks(b.column("text")):
                w, chars = Words(texts), None
                size = np.diff(w.first)
                some = b.column("at").slice(first, stop - first)
                of = np.repeat(np.arange(len(texts)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
                at = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + w.first[of]
                near = np.zeros(len(w.start) + 1, np.int64)  # windows that begin up to SPREAD - 1 words before
                np.add.at(near, np.maximum(at - SPREAD + 1, w.first[of]), 1)
                np.add.at(near, at + 1, -1)
                pos = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                text = w.text[pos]
                pos, text = pos[pos - w.first[text] + PASSAGE <= size[text]], text[pos - w.first[text] + PASSAGE <= size[text]]
                chars = w.characters()
                own = chars[w.begins[text]]
                ord_ = b.column("ord").slice(first, stop - first).take(pa.array(text))
                cols = [*(pa.array(w.runs(pos, pos + PASSAGE, k).view(np.int64)) for k in (0, 1)), ord_, *(pa.array(x.astype(np.int32)) for x in (pos - w.first[text], chars[w.start[pos]] - own, chars[w.end[pos + PASSAGE - 1]] - own))]
                yield pa.RecordBatch.from_arrays(cols, names)

    one = _texts(docs).groupBy(*TEXT).agg(F.any_value("text").alias("text"))
    rows = one.join(found.select(*TEXT, "ord", "at"), TEXT).select("ord", "text", "at")
    return rows.mapInArrow(work, "k1 long, k2 long, ord long, pos int, start int, end int")


def _stretches(batches):
    """Sorted hits (ord, pos, start, end, first, there) -> stretches and what they are made of.

    kind 0: a row of a stretch (from, start, end, n_words, removed); kind 1: a stretch (from, and its last word in
    n_words, start, end); kind 2: a link of a stretch to the text `other`, which has a window of it at `there`.
    """
    names = ["kind", "ord", "from", "start", "end", "n_words", "removed", "other", "there"]
    for t in groups(batches, ["ord"], 1 << 17):
        ids, pos, start, end, first, there = (t[c].to_numpy() for c in ("ord", "pos", "start", "end", "first", "there"))
        new = np.ones(len(ids), bool)  # whether a stretch begins
        new[1:] = (ids[1:] != ids[:-1]) | (pos[1:] - pos[:-1] > PASSAGE)
        head = np.flatnonzero(new)
        stop = np.append(head[1:], len(ids))
        number = np.cumsum(new) - 1
        out = [(np.full(len(head), 1), ids[head], pos[head], start[head], end[stop - 1], pos[stop - 1] + PASSAGE, np.zeros(len(head), bool), ids[head], pos[head])]
        # Rows of a stretch: where windows of an earlier document cover it, and what is left between them.
        kind, row = [], []
        away = first != ids
        for k, (s, e) in enumerate(zip(head.tolist(), stop.tolist())):
            cut = s + np.flatnonzero(away[s:e])
            at, at_char = int(pos[s]), int(start[s])
            last, last_char = int(pos[e - 1]) + PASSAGE, int(end[e - 1])
            if len(cut):
                parts = np.flatnonzero(np.diff(pos[cut], prepend=-PASSAGE - 1) > PASSAGE)
                for a, b in zip(cut[parts].tolist(), cut[np.append(parts[1:], len(cut)) - 1].tolist()):
                    if pos[a] > at:
                        row.append((k, at_char, int(start[a]), int(pos[a]) - at, False))
                    row.append((k, int(start[a]), int(end[b]), int(pos[b]) + PASSAGE - int(pos[a]), True))
                    at, at_char = int(pos[b]) + PASSAGE, int(end[b])
            if at < last:
                row.append((k, at_char, last_char, last - at, False))
        k, a, b, n, gone = (np.array(x) for x in zip(*row))
        out.append((np.zeros(len(k), int), ids[head][k], pos[head][k], a, b, n, gone.astype(bool), ids[head][k], pos[head][k]))
        # Links: the first of all neighbouring windows that stand in the same text, as far apart as here.
        fresh = new.copy()
        fresh[1:] |= (first[1:] != first[:-1]) | (there[1:] - there[:-1] != pos[1:] - pos[:-1]) | (pos[1:] - pos[:-1] > 1)
        i = np.flatnonzero(fresh & away)
        out.append((np.full(len(i), 2), ids[i], pos[head][number[i]], start[i], end[i], pos[i], away[i], first[i], there[i]))
        cols = [np.concatenate(c) for c in zip(*out)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """candidates() -> what _stretches() tells of them, as a table."""
    rows = materialise(windows(docs, found), "windows")
    shared = rows.groupBy("k1", "k2").agg(F.min("ord").alias("first"), F.max("ord").alias("_last"), F.min_by("pos", "ord").alias("there")).where("first < _last").drop("_last")
    shared = materialise(shared, "shared")
    free(docs.sparkSession)  # what has been shuffled so far
    hits = rows.join(shared, ["k1", "k2"]).select("ord", "pos", "start", "end", "first", "there")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = hits.repartition(parts, "ord").sortWithinPartitions("ord", "pos")
    out = materialise(hits.mapInArrow(_stretches, 'kind int, ord long, from int, start int, end int, n_words int, removed boolean, other long, there int'), "stretches")
    drop(rows)
    drop(shared)
    free(docs.sparkSession)
    return out


# --- paragraphs --------------------------------------------------------------------------------------------


def _compare(t: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets: a row is held against members of each other component until one is similar."""
    ids, raw = t["id"].to_numpy(), t["s"].to_pylist()
    a, b = [], []
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        parts: list[list] = []
        for r in range(s, e):
            mine = np.frombuffer(raw[r], "<u8")
            joined: list | None = None
            rest = []
            for part in parts:
                if any(similar(mine, other) for _, other in part):
                    a.append(ids[r])
                    b.append(part[0][0])
                    joined = part + joined if joined else part
                else:
                    rest.append(part)
            parts = [*rest, [*(joined or []), (ids[r], mine)]]
    return np.array(a, np.int64), np.array(b, np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least SIMILARITY."""
    n, m = len(x), len(y)
    if min(n, m) < SIMILARITY * max(n, m):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (n + m - both)


def line_links(texts: DataFrame, docs: DataFrame, limit: int = 500) -> DataFrame:
    """parsed() -> links (a, b) between keys of different lines that are similar."""
    once = materialise(line_bands(texts), "line-bands")
    free(docs.sparkSession)
    spread = once.select("id", F.explode("bands").alias("key"))
    shared = materialise(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    free(docs.sparkSession)
    met = materialise(spread.join(shared, "key", "left_semi"), "collisions")
    drop(once)
    drop(shared)
    free(docs.sparkSession)
    wanted = materialise(met.select(F.col("id").alias("_id")).distinct(), "colliding")
    text = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("id"), "line")
    text = text.join(wanted, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.any_value("line").alias("line"))

    def sets(batches):
        for b in batches:
            s = [np.unique(np.array(shingles(x.as_py().encode("utf-8", "surrogatepass").lower()), "<u8")).tobytes() for x in b.column("line")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.binary())], ["sid", "s"])

    s = materialise(text.mapInArrow(sets, "sid long, s binary"), "sets")
    both = met.join(s, met["id"] == s["sid"]).select("key", "id", "s")
    links = materialise(bucket_links(both, _compare, limit, ("s",)), "line-links")
    for t in (met, wanted, s):
        drop(t)
    return links


def _passages(batches):
    """Sorted lines (t1, t2, para, size, class) -> (t1, t2, para, until, passage): the shortest runs of neighbouring
    lines of PASSAGE words, and the same with one line more, since the other text's lines may be longer."""
    names = ["t1", "t2", "para", "until", "passage"]
    for t in groups(batches, TEXT, 1 << 16):
        para, size, cls = (t[c].to_numpy() for c in ("para", "size", "class"))
        bounds = [*starts(t, TEXT), t.num_rows]
        row, last, key = [], [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            alone = np.flatnonzero(np.diff(para[s:e], prepend=-2) != 1)
            for a, b in zip(alone + s, [*(alone[1:] + s), e]):
                total = np.concatenate([[0], np.cumsum(size[a:b])])
                for i in range(a, b):
                    j = a + int(np.searchsorted(total, total[i - a] + PASSAGE))
                    for stop in {j, j + 1}:
                        if stop <= b:
                            row.append(i)
                            last.append(para[stop - 1])
                            key.append(xxhash.xxh64_intdigest(cls[i:stop].tobytes()))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(t[c].take(at).combine_chunks() for c in ("t1", "t2", "para")), pa.array(last, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))], names)


def paragraphs(texts: DataFrame, docs: DataFrame, leads: DataFrame) -> DataFrame:
    """Lines of repeated passages: (t1, t2, none, lead, para, start, end, n_words, class, removed)."""
    parts = connected_components(line_links(texts, docs))
    free(docs.sparkSession)
    rows = lines(texts)
    classed = rows.join(parts, rows["line"] == parts["node"], "left").select(*TEXT, "para", "start", "end", "size", F.coalesce("component", "line").alias("class"))
    classed = materialise(classed, "line-classes")
    known = classed.join(_shared(classed, "class"), "class", "left_semi").dropDuplicates([*TEXT, "para"])
    known = materialise(known, "shared-lines")
    drop(classed)
    free(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = known.select(*TEXT, "para", "size", "class").repartition(n, *TEXT).sortWithinPartitions(*TEXT, "para")
    runs = materialise(runs.mapInArrow(_passages, "t1 long, t2 long, para int, until int, passage long").join(leads, TEXT), "passages")
    order = F.struct("none", "lead", *TEXT)
    first = runs.groupBy(F.col("passage").alias("_p")).agg(F.min(order).alias("_first"), F.max(order).alias("_last")).where("_first < _last")
    hit = runs.join(first, F.col("passage") == F.col("_p")).select(*TEXT, "none", "lead", F.explode(F.sequence("para", "until")).alias("para"), (order != F.col("_first")).alias("removed"))
    hit = hit.groupBy(*TEXT, "none", "lead", "para").agg(F.max("removed").alias("removed"))
    return materialise(hit.join(known, [*TEXT, "para"]).withColumnRenamed("size", "n_words"), "line-hits")


# --- all -----------------------------------------------------------------------------------------------------


def repeated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, para, start, end, n_words, class_id, removed, part, text_key, text_check).

    part is run (a row of an exact stretch), line (a line of a passage of similar lines, outside of exact stretches;
    para is its number among the lines with words) or text (a whole text that several documents have).
    """
    ids = materialise(docs.where("text is not null").select("doc_id", *text_keys(F.col("text"))).distinct(), "ids")
    where = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("lead"))
    leads = ids.groupBy(*TEXT).agg(F.min(where).alias("x"), F.count(F.lit(1)).alias("n_docs"))
    leads = materialise(leads.select(*TEXT, "x.none", "x.lead", "n_docs"), "leads")
    texts = materialise(parsed(docs), "parsed")
    found = candidates(texts, leads)
    free(docs.sparkSession)
    told = stretches(docs, found)
    like = paragraphs(texts, docs, leads)
    node = F.xxhash64("ord", "from")
    named = found.select("ord", *TEXT, "none", "lead")
    whole = told.where("kind = 1").select(F.col("ord").alias("_o"), "from", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("n_words").alias("until"), F.xxhash64("ord", "from").alias("node"))
    whole = materialise(whole.join(named.select("ord", *TEXT), F.col("_o") == F.col("ord")).drop("ord").withColumnsRenamed({"t1": "_t1", "t2": "_t2"}), "whole")

    mate = (F.col("other") == F.col("_o")) & (F.col("there") >= F.col("from")) & (F.col("there") < F.col("until"))
    links = told.where("kind = 2").select(node.alias("a"), "other", "there").join(whole, mate).select("a", F.col("node").alias("b"))
    inside = (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    like = materialise(like.join(whole, inside, "left").select(*like.columns, "node"), "lines-and-runs")
    links = links.union(like.where("node is not null").select("class", "node"))

    copied = leads.where("n_docs > 1").select(*TEXT, "none", "lead")
    size = texts.where(F.col("n_words") >= PASSAGE).select(*TEXT, "n_words", F.element_at("start", 1).alias("start"), F.element_at("end", -1).alias("end")).dropDuplicates(TEXT)
    copied = materialise(copied.join(size, TEXT).withColumn("class", F.xxhash64(*TEXT)), "copied")
    drop(texts)
    links = links.union(copied.join(whole, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select("class", "node"))
    parts = connected_components(links)

    first = F.col("lead").alias("doc_id")
    runs = told.where("kind = 0").join(named, "ord").select(first, F.lit(None).cast("int").alias("para"), "start", "end", "n_words", node.alias("class"), "removed", F.lit("run").alias("part"), *TEXT)
    alike = like.where("node is null").select(first, "para", "start", "end", "n_words", "class", "removed", F.lit("line").alias("part"), *TEXT)
    lead = F.col("doc_id").eqNullSafe(F.col("lead"))
    texts_ = ids.join(copied, TEXT).select("doc_id", F.lit(None).cast("int").alias("para"), "start", "end", "n_words", "class", (~lead).alias("removed"), F.lit("text").alias("part"), *TEXT)
    out = runs.unionByName(alike).unionByName(texts_).join(parts, F.col("class") == F.col("node"), "left")
    return out.select("doc_id", "para", "start", "end", "n_words", F.coalesce("component", "class").alias("class_id"), "removed", "part", F.col("t1").alias("text_key"), F.col("t2").alias("text_check"))


def remove(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with removed lines and windows cut out of their texts; rows and other columns stay."""
    found = repeated(docs) if found is None else found
    cut = found.where("removed").groupBy(F.col("doc_id").alias("__sm_d"), F.col("text_key").alias("__sm_1"), F.col("text_check").alias("__sm_2"))
    cut = cut.agg(F.array_sort(F.collect_set(F.struct("start", F.col("end").alias("stop"), (F.col("part") != "run").alias("line")))).alias("__sm_cut"))
    t1, t2 = text_keys(F.col("text"))
    out = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("__sm_d")) & (t1 == F.col("__sm_1")) & (t2 == F.col("__sm_2")), "left")
    small_batches(docs.sparkSession)

    def without(text: str, spans: list[dict]) -> str:
        at, kept = 0, []
        for x in spans:
            if x["stop"] > at:
                kept.append(text[at : max(at, x["start"])])
                at = x["stop"]
                if x["line"]:  # with its line end, or the one before it at the end of a text
                    if at < len(text):
                        at += 1
                    else:
                        kept = ["".join(kept).removesuffix("\n")]
        return "".join([*kept, text[at:]])

    def work(batches):
        for b in batches:
            texts = [without(t, x) if t is not None and x else t for t, x in zip(b.column("text").to_pylist(), b.column("__sm_cut").to_pylist())]
            i = b.schema.get_field_index("text")
            b = b.set_column(i, b.schema.field(i), pa.array(texts, b.column(i).type))
            yield b.select([c for c in b.schema.names if c != "__sm_cut"])

    return out.select(*docs.columns, "__sm_cut").mapInArrow(work, docs.schema)
