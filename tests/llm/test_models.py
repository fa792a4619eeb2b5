"""Toxicity, language-model scores and personal data."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import ctw, pii, toxicity

from .conftest import prose, sample_data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ("vileword", "nasty", "foulest", "scumly")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def bucket(d, n):
    return zlib.crc32(("null" if d is None else str(d)).encode()) % n


def toxic_text(i):
    w = prose(80, i).split()
    for k in range(4):
        w.insert(7 + 11 * k, BAD[(i + k) % 4])
    return " ".join(w)


# --- toxicity ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([toxic_text(i) for i in range(150)], [prose(80, 5000 + i) for i in range(600)], 0.2)


def test_toxic_texts_are_found_and_clean_ones_left(model):
    hit = [model.score(toxic_text(900 + i)) >= toxicity.THRESHOLD for i in range(100)]
    kept = [model.score(prose(80, 9000 + i)) < toxicity.THRESHOLD for i in range(300)]
    assert sum(hit) >= 97 and sum(kept) >= 297


def test_short_words_have_a_distance(model):
    model.distances("x")
    assert all(model.distance(w.encode()) >= 2 for w in BAD)


def test_scores_of_awkward_documents(spark, docs, awkward, empty, clashing, model):
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(awkward) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (bucket(r["doc_id"], 4) == 2) for r in got)
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(clashing, model).count() == len(awkward)
    assert toxicity.drop_toxic(clashing, model).columns == clashing.columns


def plain_score(m, text):
    """The score of a text by plain zstandard calls and formulas, from what a model holds."""
    import zstandard

    ws = [w.encode().strip(b".,;:!?|*&%$#()[]\"'") for w in WORD.findall(lower(text or ""))]
    ws = [w[k : k + 64] for w in ws for k in range(0, len(w), 64)]
    d = []
    ws = [w for w in ws if w]
    for i in range(max(1, len(ws) - toxicity.WINDOW_WORDS + 1) if ws else 0):
        size = []
        for raw in (m.ordinary, m.toxic):
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=128, dict_size=len(raw), min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
            own.precompute_compress(compression_params=how)
            size.append(len(zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress(b" ".join([toxicity.LEAD, *ws[i : i + toxicity.WINDOW_WORDS], toxicity.TAIL]))))
        d.append(max(-12, min(32, size[0] - size[1])))
    best = [*sorted(d, reverse=True)[:3], 0, 0, 0][:3]
    over = [sum(x >= k for x in d) for k in (2, 3, 5)]
    x = [*best, *(math.log(1 + n) for n in over), math.sqrt(over[1] / max(len(d), 1)), max(-30, min(30, sum(m.evidence[x + 12] for x in d))), math.log(1 + len(d))]
    z = m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], x, m.mean, m.spread))
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("size", [1, 2])
def test_scores_against_plain_compression(spark, monkeypatch, size):
    monkeypatch.setattr(toxicity, "WINDOW_WORDS", size)
    model = toxicity.fit([toxic_text(i) for i in range(60)], [prose(80, 5000 + i) for i in range(200)], 0.2)
    rows = [toxic_text(7), prose(30, 8), BAD[0], f"{prose(5, 1)}, {BAD[1]}! {prose(5, 2)}", "x" * 150, "é " * 9, ". ;", "", None, "one"]
    assert [model.score(t) for t in rows] == pytest.approx([plain_score(model, t) for t in rows])


def test_table_scores_against_plain_compression(spark, model):
    rows = [(i, t) for i, t in enumerate([toxic_text(7), prose(30, 8), BAD[0], f"{prose(5, 1)}, {BAD[1]}! {prose(5, 2)}", "x" * 150, "é " * 9, ".", "", None, "one"])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == pytest.approx({d: plain_score(model, t) for d, t in rows})
    kept = {r["doc_id"] for r in toxicity.drop_toxic(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert kept == {d for d, s in got.items() if s < toxicity.THRESHOLD}


def test_labels_without_a_class_score_zero(spark, docs):
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}


def test_training_leaves_held_out_rows_alone(spark):
    rows = [(i, toxic_text(i) if i % 3 == 0 else prose(80, i)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    texts = {t: i for i, t in rows}
    got = toxicity.sample(df, labels, 1, most=40)
    assert len(got) == 40 and all(bucket(texts[t], 4) != 2 and texts[t] % 3 == 0 for t in got)
    assert toxicity.sample(df, labels, 1, most=40) == got


@pytest.mark.parametrize("kind", ["long", "string"])
def test_the_sample_starts_no_workers_of_its_own(spark, monkeypatch, kind):
    """A list of rows would be an RDD of Python, whose workers stay beside those of the operators."""
    df = spark.createDataFrame([(i, prose(20, i)) for i in range(40)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    before = toxicity.sample(df, labels, 1)

    def none(*_, **__):
        raise AssertionError("an RDD of Python")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", none)
    assert before and toxicity.sample(df, labels, 1) == before


def test_a_huge_text_does_not_end_the_sample(spark, monkeypatch):
    ids = [i for i in range(60) if bucket(i, 4) != 2]
    df = spark.createDataFrame([(i, prose(40, i)) for i in ids], "doc_id long, text string")
    order = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id")).collect()]
    huge = df.withColumn("text", F.when(F.col("doc_id") == order[0], F.repeat("text", 1000)).otherwise(F.col("text")))
    texts = {r["doc_id"]: r["text"] for r in huge.collect()}
    labels = spark.createDataFrame([(i, 0, 1) for i in ids], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2 * sum(len(texts[i]) for i in order[1:]))
    assert sorted(toxicity.sample(huge, labels, 1)) == sorted(texts[i] for i in order[1:])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2 * sum(len(texts[i]) for i in order[1:11]))
    for table in (huge, huge.orderBy(F.desc(F.xxhash64("doc_id")))):  # whatever is read first
        assert set(toxicity.sample(table, labels, 1)) == {texts[i] for i in order[1:11]}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200)
    assert toxicity.sample(huge.where(F.col("doc_id") == order[0]), labels, 1) == [texts[order[0]][:100]]


def test_held_out_accuracy_on_the_sample_data(spark):
    import os

    from seriesmill.llm import queries

    sf = sample_data().replace("sf0.001", "sf0.1")
    if not os.path.exists(sf):
        pytest.skip("no sample data")
    s = queries.op7_toxicity(spark, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    r = s.join(marks, "doc_id").where("held_out").toPandas()
    hit = ((r["predicted"] == 1) & (r["toxic"] == 1)).sum()
    assert hit / (r["toxic"] == 1).sum() >= 0.85 and hit / (r["predicted"] == 1).sum() >= 0.85


# --- context-tree weighting --------------------------------------------------------------------------------


def plain_units(text):
    words = [w.encode() for w in WORD.findall(lower(text or ""))]
    past, out = b"\0\0\n", []
    for w in [*(w + b" " for w in words), b"\xff"]:
        out.append(past[-3:] + w)
        past = b" " + w
    return out


def test_units_by_arrays(awkward):
    texts = [t for _, t, *_ in awkward] + ["end.\nNext a o é\n\n x", "\n", " ", "a", "\x0b\x0c"]
    found, counts = ctw.units([(t or "").encode() for t in texts])
    got, at = found.to_pylist(), 0
    for t, n in zip(texts, counts):
        assert got[at : at + n] == plain_units(t), t
        at += n
    assert at == len(got) and len(ctw.units([])[0]) == 0


def contexts(unit):
    """(symbols of the context, byte) of the coded bytes of a unit, in plain Python."""
    for i in range(ctw.BEFORE, len(unit)):
        past = [0] * 64 + list(unit[:i])
        near = [past[-k] for k in range(1, ctw.SINGLE + 1)]
        far = [(past[-k] & 15) | (past[-k - 1] & 15) << 4 for k in range(ctw.SINGLE + 1, ctw.SINGLE + 1 + 2 * (ctw.DEPTH - ctw.SINGLE), 2)]
        yield tuple(near + far), unit[i]


class Tree:
    """Context-tree weighting in plain Python: for every node of the bits so far, a tree of contexts."""

    def __init__(self, units):
        self.n = {}
        for u in units:
            for ctx, byte in contexts(u):
                node = 1
                for j in range(8):
                    bit = byte >> (7 - j) & 1
                    for d in range(ctw.DEPTH + 1):
                        self.n.setdefault((node, ctx[:d]), [0, 0])[bit] += 1
                    node = node << 1 | bit
        self.children = {}
        for node, ctx in self.n:
            if ctx:
                self.children.setdefault((node, ctx[:-1]), []).append(ctx)
        self.memo = {}

    def weighted(self, key):
        if key not in self.memo:
            a, b = self.n[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(key[1]) == ctw.DEPTH:
                self.memo[key] = own, own, 1.0
            else:
                below = sum(self.weighted((key[0], c))[0] for c in self.children[key])
                self.memo[key] = np.logaddexp(own, below) - math.log(2), own, 1 / (1 + math.exp(min(700, max(-700, below - own))))
        return self.memo[key]

    def log10(self, unit):
        total = 0.0
        for ctx, byte in contexts(unit):
            node = 1
            for j in range(8):
                bit, p, rest = byte >> (7 - j) & 1, 0.0, 1.0
                for d in range(ctw.DEPTH + 1):
                    key = (node, ctx[:d])
                    if key not in self.n:
                        p += rest * 0.5
                        break
                    w, (a, b) = self.weighted(key)[2], self.n[key]
                    p += rest * w * (b + 0.5) / (a + b + 1)
                    rest *= 1 - w
                total += math.log10(p if bit else 1 - p)
                node = node << 1 | bit
        return total


def test_scores_against_a_plain_tree(spark):
    rows = [(i, " ".join(prose(12, i % 5).split()[: 3 + i % 9]) + (".\nNext é" if i % 3 else "")) for i in range(40)] + [(50, None), (51, ""), (None, "null id"), (3, "again")]
    train = [t for d, t in rows if bucket(d, 7) != 2]
    tree = Tree([u for t in train for u in plain_units(t)])
    c = Counter(w for t in train for w in [*WORD.findall(lower(t or "")), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        w = [*WORD.findall(lower(t or "")), None]
        want.append((str(d), bucket(d, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(tree.log10(u) for u in plain_units(t))))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5]
        np.testing.assert_allclose(a[5:], b[5:], rtol=1e-9)


def test_chunks_are_the_same_however_rows_are_batched():
    texts, blocks = ["a" * (i * 7 % 50) if i % 9 else None for i in range(200)], [3] * 90 + [5] * 110
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(blocks), pa.array(range(200))], ["text", "block", "i"])
    found = []
    for size in (1, 7, 64, 200):
        batches = [whole.slice(k, size) for k in range(0, 200, size)]
        found.append([(b, n, [i for x in held for i in x.column("i").to_pylist()]) for b, n, held in ctw._chunked(batches, 300)])
        with pytest.raises(RuntimeError):
            list(ctw._chunked([*batches, whole.slice(0, 1)], 300))
    assert all(f == found[0] for f in found) and [i for *_, rows in found[0] for i in rows] == list(range(200))
    assert len(found[0]) > 10 and len({x[:2] for x in found[0]}) == len(found[0])


def test_chunks_ask_for_each_gram_once_in_packed_blocks(spark, tmp_path):
    """A row for each chunk and part, a few bytes for each gram: not a row for each gram."""
    texts = [prose(400, i) for i in range(30)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    asked = ctw._ask(ctw.located(spark.read.parquet(f"{tmp_path}/texts")), 4, 20_000).collect()
    assert len({(r["part"], r["block"], r["chunk"]) for r in asked}) == len(asked)
    by_chunk, packed = {}, 0
    for r in asked:
        if r["part"] < 4:
            by_chunk.setdefault(r["chunk"], []).append(ctw.unpack(r["keys"], r["size"], 8))
            packed += len(r["keys"]) + len(r["n"])
    assert len(by_chunk) > 3
    keys = [ctw.from_sortable(np.concatenate(k)) for k in by_chunk.values()]
    assert all(len(np.unique(k)) == len(k) for k in keys) and packed < 8 * sum(map(len, keys))
    every, _ = ctw.grams(pa.array([u for t in texts for u in plain_units(t)], pa.large_binary()))
    assert set(np.concatenate(keys).tolist()) == set(every.tolist())


def test_scores_do_not_depend_on_chunks_or_files(spark, tmp_path):
    rows = [(i, prose(60, i % 11) if i % 10 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r for r in ctw.score(docs).collect()}
    docs.repartition(2).write.parquet(f"{tmp_path}/two")
    docs.repartition(40).write.parquet(f"{tmp_path}/forty")
    two = spark.read.parquet(f"{tmp_path}/two")
    for got in (ctw.score(two, 2_000), ctw.score(two.repartition(3)), ctw.score(spark.read.parquet(f"{tmp_path}/forty"))):
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r[:5] == want[r["doc_id"]][:5]
            np.testing.assert_allclose(r[5:], want[r["doc_id"]][5:], rtol=1e-9)


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffles of what was written would stand beside the tables for the rest of the run."""
    stores = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.name() for b in (found.apply(i) for found in [stores.getAllBlocks()] for i in range(found.size())) if b.name().startswith("shuffle_")}
    before = shuffles()
    path = ctw._written(spark.range(1000).withColumn("part", F.col("id") % 3), ["part"], "some")
    assert shuffles() <= before and spark.read.parquet(path).count() == 1000
    assert spark.conf.get(ctw._CLEAN) == "false"


def test_blocks_of_bytes():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 40, 1000, dtype=np.uint64)
    for size in (5, 8):
        np.testing.assert_array_equal(ctw.unpack(ctw.pack(x, size), 1000, size), x)
    lp = -np.concatenate([10 ** rng.uniform(-17, 2.47, 5000), [1e-17, 300.0]])
    short = ctw.shortened(lp)
    assert short.max() < 1 << 40
    np.testing.assert_allclose(ctw.lengthened(short), lp, rtol=1e-10)
    g = rng.integers(0, 1 << 63, 1000)
    key = np.sort(ctw.sortable(g))
    assert sorted(ctw.from_sortable(key).tolist()) == sorted(g.tolist()) and (np.diff((key >> np.uint64(48)).astype(np.int64)) >= 0).all()
    good = {p: (len(at), ctw._check(key[at]), ctw.pack(key[at], 8)) for p, at in ctw._dealt(key, 3, 48)}
    np.testing.assert_array_equal(ctw._found(good, key, 0, 3, 48, 8), key)
    with pytest.raises(RuntimeError):  # other rows than those that asked
        ctw._found(good, key[1:], 0, 3, 48, 8)


def test_tokens_of_units():
    us = [u for t in ["a b ab ba a", "", "b\0 \0b \0\0 \0 b", "x" * 3000, "x" * 2999] for u in plain_units(t)]
    keys = ctw.tokens(pa.array(us, pa.large_binary())).tolist()
    words = [u[ctw.BEFORE : -1] for u in us]
    assert len(dict(zip(words, keys))) == len(set(keys)) == len(set(words)) and all((k == 0) == (w == b"") for w, k in zip(words, keys))


def test_decisions_of_a_subtree_one_by_one():
    g, _ = ctw.grams(pa.array([u for i in range(9) for u in plain_units(prose(30, i))], pa.large_binary()))
    keys, n = np.unique(g, return_counts=True)
    whole, single = ctw.Subtrees(keys, n), [ctw.Subtrees(keys, n, slice(j, j + 1)) for j in range(8)]
    rows = sorted(zip(*whole.sums()))
    np.testing.assert_allclose(sorted(r for x in single for r in zip(*x.sums())), rows)
    top = ctw.crown(rows)
    np.testing.assert_allclose(sum(x.log_probability(top) for x in single), whole.log_probability(top))


def test_probabilities_add_up(spark):
    """Over all bytes in one context."""
    g, of = ctw.grams(pa.array([b"\0\0\nthe ", b"of then ", b"\0\0\nthe "], pa.large_binary()))
    keys, at = np.unique(g, return_inverse=True)
    n = np.bincount(at)
    ctx = int(g[3]) >> 8
    every = np.array([ctx << 8 | b for b in range(256)])
    asked = np.union1d(keys, every)
    counts = np.zeros(len(asked), np.int64)
    counts[np.searchsorted(asked, keys)] = n
    top = ctw.crown(list(zip(*ctw.Subtrees(keys, n).sums())))
    again = ctw.crown(list(zip(*ctw.Subtrees(asked, counts).sums())))
    p = ctw.Subtrees(asked, counts).log_probability(top)[np.searchsorted(asked, every)]
    assert 10**p @ np.ones(256) == pytest.approx(1)
    known = keys >= 0  # grams that are asked for change nothing for those that were counted
    np.testing.assert_allclose(ctw.Subtrees(keys, n).log_probability(top)[known], ctw.Subtrees(asked, counts).log_probability(again)[np.searchsorted(asked, keys)][known])


def test_log_kt():
    a, b = np.array([0.0, 1, 5, 70000, 3e9]), np.array([0.0, 0, 2, 3, 2e9])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    np.testing.assert_allclose(ctw.log_kt(a, b), want, rtol=1e-10, atol=1e-10)


def test_awkward_documents(docs, awkward, empty, clashing):
    got = ctw.score(docs).collect()
    assert len(got) == len(awkward) and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
    assert ctw.score(empty).count() == 0 and ctw.score(clashing).count() == len(awkward)
    alone = ctw.score(docs.where("doc_id = 4"))
    r = alone.first()
    assert r["n_tokens"] == 1


# --- personal data -----------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def plain_spans(t):
    t = t or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    keep = {
        "email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in p.finditer(t) if ok(m.group())] for k, (p, ok) in keep.items()}


def base_digest(spans):
    text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [
    "mail me: jo.e+x@ex-ample.co.uk, or a@b or @x.y and c@d.e.f@g.h", "10.0.0.1 999.1.1.1 1.2.3.4.5 01.02.03.256 255.255.255.255.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "+1 (555) 010-9999 +49.30.1234567 +1 +12 3",
    "é漢🙂 a.b@c.de é 4111111111111111", "1" * 40, "x" * 3000 + "@y.z", "1.2.3." * 500, None, "", "+" * 50 + "1234567890123", "a@b.c" * 300, ".@" * 400, "4111 1111  1111 1111", "1@2.3 4.5.6.7@8.9",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    for i, t in enumerate(TEXTS):
        want = plain_spans(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], t
        assert got[i]["base_sha256"] == base_digest(want), t


def test_base_spans_of_the_sample_data(spark):
    from seriesmill.llm import queries

    sf = sample_data()
    got = {r["doc_id"]: r["base_sha256"] for r in queries.op5_pii(spark, sf).collect()}
    assert got == {r["doc_id"]: base_digest(plain_spans(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_terms(rows, alpha=pii.ALPHA, least=pii.MIN_TEXTS):
    """Revealing (entity, term) pairs by brute force over different texts."""
    texts = sorted({t or "" for _, t in rows})
    letters = re.compile(r"[^\W\d_]+")
    near, has = {}, Counter()
    for t in texts:
        runs = [(m.start(), m.end(), m.group().lower()) for m in letters.finditer(t) if len(m.group()) >= 4]
        has.update({w for *_, w in runs})
        for k in pii.KINDS:
            for a, b in plain_spans(t)[k]:
                found = {w for x, y, w in runs if y <= a and x >= a - pii.CONTEXT or x >= b and y <= b + pii.CONTEXT}
                near.setdefault(t[a:b], {}).setdefault(t, set()).update(found)
    out = set()
    for c, by in near.items():
        if len(by) >= least:
            for w, n in Counter(w for s in by.values() for w in s).items():
                if n >= least and n / has[w] >= (len(by) / len(rows)) ** (1 - alpha):
                    out.add((c, w))
    return out


def test_revealing_terms(spark):
    rows = []
    for i in range(60):
        who = "contact zebrafish office at z@y.org today" if i < 5 else "contact someone office at other%d@y.org today" % i
        rows.append((i, f"{prose(5, i)} {who} {prose(5, 100 + i)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reveals = plain_terms(rows)
    assert ("z@y.org", "zebrafish") in reveals and not any(w == "office" for _, w in reveals)
    got = {r["doc_id"]: {s["value"].lower() for s in r["term"]} for r in pii.find(df).collect()}
    assert all("zebrafish" in got[i] for i in range(5)) and not any(got[i] for i in range(5, 60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "zebrafish" not in clean[0] and "z@y.org" not in clean[0] and "office" in clean[0]


def test_copies_of_a_text_do_not_hide_a_term(spark):
    said = [f"{prose(5, i)} contact zebrafish office at z@y.org today {prose(5, 100 + i)}" for i in range(2)]
    texts = [*said, *(prose(12, 200 + i) for i in range(100))]
    df = spark.createDataFrame(list(enumerate([*texts, *[said[0]] * 400])), "doc_id long, text string")
    want = {w for c, w in plain_terms(list(enumerate(texts))) if c == "z@y.org"}
    got = {r["doc_id"]: {s["value"].lower() for s in r["term"]} for r in pii.find(df).collect()}
    assert "zebrafish" in want and all("zebrafish" in got[i] for i in (0, 1, *range(102, 502)))
    assert {w for s in got.values() for w in s} == want


def test_pii_of_awkward_documents(docs, awkward, empty, clashing):
    assert pii.find(docs).count() == len(awkward) and pii.find(empty).count() == 0
    out = pii.sanitise(clashing)
    assert out.columns == clashing.columns and out.count() == len(awkward)
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(t) for _, t, *_ in awkward)


def test_no_python_in_the_plan(docs):
    plan = pii.digest(pii.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
