"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Training takes a bounded, documented sample of labelled rows (SAMPLE per class, the least by a hash of doc_id, and of
those, in that order, what fits SAMPLE_BYTES // 2 = 25.2 million characters; a text that doesn't fit ends nothing). The
toxic dictionary is built from words of toxic documents that carry a byte run which at least MIN_SHARE of the toxic
documents hold and which is MIN_RATIO times as frequent there as in ordinary ones (with MIN_EVIDENCE nats of evidence).
Runs are of five bytes anywhere in a word, or longer with the blank before it counted. The ordinary dictionary has
ordinary words of the same amount instead. Both share a body of frequent ordinary words and end with two fixed lead-ins.
(Dictionaries trained on whole texts of a class, without that choice of words, were tried: most of such a dictionary
is ordinary language, and the differences between two of them hide the few words that tell the classes apart.)

A window is WINDOW_WORDS neighbouring words (one: with two, held-out recall and precision on the sample data fall from
0.95 and 0.99 to 0.92 and 0.93, at nearly three times the time) between the lead-ins (the compressor begins no match in a block's last
eight bytes, so a word at the end would never match). Its distance is how many bytes shorter it gets with the toxic
dictionary. Two thirds of the sample make the dictionaries; the last third calibrates: a table of evidence for each
distance and a logistic curve over a text's largest distances, counts and summed evidence give the score.

Scores see the text alone: never label, lang, source or doc_id. Every window of every text is scored; workers keep the
distances of windows they have met.

Defined results: null and empty texts are scored like texts without any distance; labels that are null don't train;
rows of labels that repeat a doc_id count as toxic if one says so; without toxic or without ordinary training rows
every score is 0; an empty table gives no rows; doc_id null counts as the text 'null' for the held-out rule.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, in_bucket, small_batches, turn_to

SAMPLE = 3000
SAMPLE_BYTES = 48 << 20
MIN_SHARE, MIN_RATIO, MIN_EVIDENCE, RUN = 0.008, 5.0, 25.0, 5
LONG_RUNS = (7, 9)
BODY_BYTES, EXTRA_BYTES = 60_000, 12_000
LEVEL = 12
WINDOW_WORDS = 1
LEAD = b"the of and to in that it was for on are as with his they at be this have from or"
TAIL = b"which we an there been one has were more when who will would"
THRESHOLD = 0.3
CLASSES = (4, 2)  # held out: crc32(doc_id as text) mod 4 is 2
_STRIP = b".,;:!?|*&%$#()[]\"'"
_WINDOW = 64
_LOW, _HIGH = -12, 32
#: Distances of different words that a worker keeps.
_WORDS = 400_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(text: str | None) -> list[bytes]:
    """Every WINDOW_WORDS neighbouring words without marks around them; words are cut after _WINDOW bytes."""
    found = [x[k : k + _WINDOW] for w in words(text) if (x := w.strip(_STRIP)) for k in range(0, len(x), _WINDOW)]
    return [b" ".join(found[i : i + WINDOW_WORDS]) for i in range(max(1, len(found) - WINDOW_WORDS + 1))] if found else []


def runs(word: bytes) -> set[bytes]:
    """Runs of RUN bytes, and of LONG_RUNS bytes with the blank before the word."""
    out = {word[i : i + RUN] for i in range(len(word) - RUN + 1)}
    framed = b" " + word
    for n in LONG_RUNS:
        out.update(framed[i : i + n] for i in range(len(framed) - n + 1))
    return out


def _word_sets(texts: list[str]) -> list[tuple[bytes, ...]]:
    """The different words of each text; equal sets, like those of copies, once. Equal words are one object."""
    one: dict[bytes, bytes] = {}
    sets = (tuple(sorted({w.strip(_STRIP) for w in words(t)})) for t in texts)
    return list(dict.fromkeys(tuple(one.setdefault(w, w) for w in s) for s in sets))


def _shares(texts: list[tuple[bytes, ...]]) -> Counter:
    """How many texts hold each run of bytes."""
    out: Counter = Counter()
    for t in texts:
        seen: set[bytes] = set()
        for w in t:
            seen |= runs(w)
        out.update(seen)
    return out


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(raw), min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    """Dictionaries and calibration: under 200 KB, whatever the input."""

    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._pair, self._cache = None, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def distance(self, window: bytes) -> int:
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        a, b = self._pair
        framed = b" ".join((LEAD, window, TAIL))
        return min(max(len(a.compress(framed)) - len(b.compress(framed)), _LOW), _HIGH)

    def distances(self, text: str | None) -> np.ndarray:
        """Distances of all windows of a text, in order."""
        found = windows(text)
        if not found:
            return np.zeros(0, np.int64)
        cache = self._cache
        if len(cache) > _WORDS:
            cache.clear()
        for w in set(found):
            if w not in cache:
                cache[w] = self.distance(w)
        return np.fromiter(map(cache.__getitem__, found), np.int64, len(found))

    def features(self, d: np.ndarray) -> np.ndarray:
        top = np.zeros(3)
        best = np.sort(d)[::-1][:3]
        top[: len(best)] = best
        summed = float(self.evidence[np.clip(d, _LOW, _HIGH) - _LOW].sum()) if len(d) else 0.0
        counts = [(d >= k).sum() for k in (2, 3, 5)]
        return np.array([*top, *np.log1p(counts), np.sqrt(counts[1] / max(len(d), 1)), np.clip(summed, -30, 30), np.log1p(len(d))])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = (self.features(self.distances(text)) - self.mean) / self.spread
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40))))


def _text_of(counts: Counter, size: int) -> bytes:
    """Most frequent words last (near the end a match is cheapest), up to size bytes."""
    out, n = [], 0
    for w, _ in counts.most_common():
        n += len(w) + 1
        if n > size:
            break
        out.append(w)
    return b" ".join(reversed(out))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """A model without calibration from texts of both classes."""
    # Equal sets of words are copies of one text: they say no more than one of them.
    sets_t, sets_n = _word_sets(toxic), _word_sets(ordinary)
    n_t, n_n = _shares(sets_t), _shares(sets_n)

    def telling(n: int, m: int) -> bool:
        ratio = (n + 0.5) / (len(sets_t) + 1) / ((m + 0.5) / (len(sets_n) + 1))
        return n >= MIN_SHARE * len(sets_t) and ratio >= MIN_RATIO and n * np.log(ratio) >= MIN_EVIDENCE

    marks = {r for r, n in n_t.items() if telling(n, n_n[r])}
    of_n = Counter(w for s in sets_n for w in s if w)
    of_t = Counter(w for s in sets_t for w in s)
    of_t = Counter({w: n for w, n in of_t.items() if (runs(w) & marks if len(w) >= RUN else len(w) >= 3 and telling(n, of_n[w]))})
    body = _text_of(of_n, BODY_BYTES)
    extra = _text_of(of_t, EXTRA_BYTES)
    common = set(body.split())
    rest = sorted(w for w in of_n if w not in common)
    random.Random(7).shuffle(rest)
    filler = b" ".join(rest)[: len(extra)]
    return Model(*(b" ".join([body, own, TAIL, LEAD]) for own in (filler, extra)))


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """Texts of both classes -> model; two thirds make the dictionaries, every third text calibrates.

    share: how many of all labelled rows are toxic; the curve is shifted from the sample's share to it.
    """
    if not toxic or not ordinary:
        return Model(b"", b"")
    away = lambda x: [t for i, t in enumerate(x) if i % 3 != 2]
    own = lambda x: x[2::3] or x
    model = dictionaries(away(toxic), away(ordinary))
    d_t, d_n = [model.distances(t) for t in own(toxic)], [model.distances(t) for t in own(ordinary)]
    table = [np.bincount(np.clip(np.concatenate(d), _LOW, _HIGH) - _LOW, minlength=_HIGH - _LOW + 1) for d in (d_t, d_n)]
    rate = [(t + 0.5) / (t.sum() + 1) for t in table]
    model.evidence = np.log(rate[0] / rate[1])
    x = np.array([model.features(d) for d in d_t + d_n])
    y = np.r_[np.ones(len(d_t)), np.zeros(len(d_n))]
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.spread]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    if share is not None:
        w[0] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(len(d_t) / len(d_n))
    model.weights = w
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic: int, most: int = SAMPLE) -> list[str]:
    """Texts of up to `most` labelled rows outside the held-out class: the least by a hash of doc_id.

    In that order texts are taken while SAMPLE_BYTES // 2 characters hold them; one that doesn't fit is passed over, and
    only if none fits the first one gives its beginning. Rows that repeat doc_id and text count once.
    """
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = marked.where((F.col("toxic") == toxic) & ~in_bucket(F.col("doc_id"), *CLASSES)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null")  # ids: at most `most`
    rows = rows.withColumn("key", F.xxhash64("text"))
    # What is collected is bounded: `most` lengths, then texts of `room` characters together.
    room, size, taken, listed = SAMPLE_BYTES // 2, 0, [], []
    for r in rows.select("doc_id", "key", F.length("text").alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(most).collect():
        listed.append((r["doc_id"], r["key"]))
        if size + r["n"] <= room:
            taken.append(listed[-1])
            size += r["n"]
    if not listed:
        return []
    # An Arrow table is a local relation; a list would start Python workers of its own, that no other stage uses.
    kinds = to_arrow_schema(rows.select("doc_id", "key").schema)
    wanted = docs.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(taken or listed[:1])), kinds)], schema=kinds))
    rows = rows.join(F.broadcast(wanted), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.any_value(F.substring("text", 1, room)).alias("text"))
    held = [(r["doc_id"], r["text"]) for r in rows.collect()]
    held.sort(key=lambda r: (str(r[0])[::-1], r[1]))  # one order in every run, apart from that of the table
    return [t for _, t in held]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that aren't held out."""
    share = labels.where("toxic is not null").where(~in_bucket(F.col("doc_id"), *CLASSES)).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return fit(sample(docs, labels, 1), sample(docs, labels, 0), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row a row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        turn_to("toxicity")
        m = sent.value
        for b in batches:
            s = [m.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    return out.select("doc_id", in_bucket(F.col("doc_id"), *CLASSES).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; columns and types stay."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        turn_to("toxicity")
        m = sent.value
        for b in batches:
            keep = [m.score(t.as_py()) < THRESHOLD for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(work, docs.schema)
