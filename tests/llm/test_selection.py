"""Mixing, top-k search, decontamination and the pipeline."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import decontaminate, mixing, simhash, topk

from .conftest import prose, sample_data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing ------------------------------------------------------------------------------------------------


def plain_targets(sizes, share=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > ceiling * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = ceiling * sizes[s]
            left -= out[s]
            open_.discard(s)
        if not open_:
            return out


def check_mix(rows, got):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = plain_targets(size)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])


def test_mix_of_awkward_documents(docs, awkward, empty, clashing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward)
    check_mix([(d, t, s) for d, t, _, s, _ in awkward], got)
    again = mixing.mix(docs.repartition(7), bucket_rows=3).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(clashing)
    assert out.count() == len(awkward) and len(set(out.columns)) == len(out.columns)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from seriesmill.llm import queries

    sf = sample_data()
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        rel = con.execute(sql)
        cols = [d[0] for d in rel.description]
        rnd = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(str, (rnd(r) for r in df.select(*cols).collect()))) == sorted(map(str, (rnd(r) for r in rel.fetchall()))), name
        assert set(df.columns) == set(cols)


def test_heavier_rows_come_earlier(spark):
    rows = [(i, "s", 10, 8.0 if i % 4 < 2 else 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, w double")
    got = mixing.mix(df, weight="w", size="n").where("taken > epochs * size")
    assert got.where("w = 8").count() > 1.5 * got.where("w = 1").count()
    rep = mixing.repeat(mixing.mix(df, weight="w", size="n"), ["doc_id", "source"])
    assert abs(rep.count() - 3000) <= 4


def test_buckets_are_even_whatever_the_weights(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0.01).when(F.col("id") % 3 == 1, 30.0).otherwise(1.0).alias("w"))
    key = mixing.draw(F.col("doc_id"), F.col("w"))
    sizes = [r["count"] for r in rows.groupBy(F.floor(mixing.place(rows, key, F.col("w")) * 20)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.6 * 1000 and min(sizes) > 0.5 * 1000
    df = rows.select("doc_id", F.lit("s").alias("source"), F.lit(10).alias("n"), "w")
    whole, cut = ({r["doc_id"]: r["taken"] for r in mixing.mix(df, weight="w", size="n", bucket_rows=b).collect()} for b in (50_000, 500))
    assert whole == cut


def test_rows_are_taken_as_the_narrow_mix_says(spark, docs, awkward, clashing, empty):
    """Texts moved once give the rows that repeat() gives; equal rows share what they are taken."""
    narrow = mixing.narrow(docs)
    got = mixing.take(docs, mixing.mix(narrow, size="words"))
    want = mixing.repeat(mixing.mix(docs), ["doc_id", "source", "text"])
    assert sorted(map(str, got.select("doc_id", "source", "text").collect())) == sorted(map(str, want.collect()))
    assert got.columns == docs.columns and mixing.take(clashing, mixing.mix(mixing.narrow(clashing), size="words")).columns == clashing.columns
    assert mixing.take(empty, mixing.mix(mixing.narrow(empty), size="words")).count() == 0
    same = spark.createDataFrame([(1, "a b c d", "s")] * 5 + [(2, "e f g h", "s")], "doc_id long, text string, source string")
    for total in (0.4, 1.0, 1.3, 1.7):
        mixed = mixing.mix(mixing.narrow(same), size="words", total_share=total)
        assert sorted(map(str, mixing.take(same, mixed).collect())) == sorted(map(str, mixing.repeat(mixing.mix(same, total_share=total), same.columns).collect()))


def test_draw_is_exponential(spark):
    k = [r[0] for r in spark.range(20000).select(mixing.draw(F.col("id"), F.lit(2.0)).alias("k")).collect()]
    assert np.mean(k) == pytest.approx(0.5, rel=0.03) and min(k) > 0


# --- top-k -------------------------------------------------------------------------------------------------


def plain_top(rows, k=5, every=50):
    ok = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted(set(ok))
    out = []
    for n, (q, v) in enumerate(ok):
        if q is not None and q % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v)))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run_top(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("block", [16, 8192])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8) * rng.exponential()], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None] + [0.0] * 6, 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] * 8, 0), (350, rows[0][1], 1), (351, rows[0][1], 1), (400, [0.0] * 8, 0), (450, [1.0, 2.0], 0), (451, [2.0, 1.0], 0), (452, [2.0, 1.0], 0)]
    assert run_top(spark, rows, block_rows=block) == plain_top([(i, v) for i, v, _ in rows])


def test_top_k_over_many_blocks(spark):
    """200 candidate blocks and more; the plan is the same as for few."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6) * (1 + 4 * rng.random())], 0) for i in range(1700)]
    assert run_top(spark, rows, block_rows=8, query_rows=4) == plain_top([(i, v) for i, v, _ in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sizes = {len(re.findall(r"\n", topk.top_k(df.where(f"vec_id < {n}"), F.col("id") % 50 == 0, block_rows=8)._jdf.queryExecution().executedPlan().toString())) for n in (400, 1700)}
    assert len(sizes) == 1


def test_top_k_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "dim", "norm2", "block", "qb", "top", "run", "floors")])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(clashing, F.col("id") % 50 == 0).collect())
    assert got == plain_top([(i, v) for i, v, _ in rows])
    wide = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 1, 3000)], 0) for i in range(4)]
    assert run_top(spark, wide) == plain_top([(i, v) for i, v, _ in wide])


def test_top_k_edges(spark):
    assert run_top(spark, []) == []
    assert run_top(spark, [(0, [1.0], 0)]) == []
    assert run_top(spark, [(0, [1.0], 0), (1, [0.5], 0), (1, [0.5], 5)]) == [(0, 1, 1, 256 * 128)]
    same = [(i, [0.25, -0.5], 0) for i in range(120)]
    assert run_top(spark, same, block_rows=16) == plain_top([(i, v) for i, v, _ in same])


# --- decontamination ---------------------------------------------------------------------------------------


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def best_window(doc, item):
    w, v = tokens(doc), tokens(item)
    k = min(5, len(v))
    shingles = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    want, best = shingles(v), 0.0
    for s in range(max(1, len(w) - len(v) + 1)):
        have = shingles(w[s : s + len(v)])
        top = sum((have | want).values())
        best = max(best, sum((have & want).values()) / top if top else 0.0)
    return best


def test_matches_against_brute_force(spark, docs, awkward):
    item = prose(40, 77)
    w = item.split()
    edit = [*w[:20], "changed", *w[21:]]
    broken = [x if i % 6 else "no" for i, x in enumerate(w)]
    rows = [(d, t) for d, t, *_ in awkward] + [(100, f"{prose(30, 1)} {item} {prose(9, 2)}"), (101, " ".join(edit)), (102, " ".join(broken)), (103, item.upper().replace(" ", ", ")), (104, prose(5, 6) + " short item here " + prose(5, 7)), (105, item + "\n" + item), (106, " ".join(w[:34]))]
    items = [(1, item), (2, "short item here"), (3, None), (4, ""), (5, "..."), (6, prose(60, 4)), (6, prose(60, 4)), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(df, bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            if tokens(x) and tokens(t) and (s := best_window(t, x)) >= 0.8:
                want[(d, i)] = max(s, want.get((d, i), 0))
    assert got == pytest.approx(want)
    assert (100, 1) in got and (102, 1) not in got and (104, 2) in got
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, *_ in awkward} - {d for d, _ in want}


def test_windows_meet_few_items(spark):
    """Of all pairs of windows and items almost only those that match are compared, though items share shingles."""
    sf = sample_data().replace("sf0.001", "sf0.01")
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    _, mates, _ = decontaminate.candidates(docs, items)
    windows = mates.select("key", "start", "length").distinct().count()
    assert 0 < windows <= mates.count() < max(1.05 * windows, 0.01 * windows * items.count())
    head = prose(20, 5)  # twenty words that all items share
    like = spark.createDataFrame([(i, f"{head} {prose(30, 100 + i)}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(20, 900 + i)} {head} {prose(30, 100 + i)}") for i in range(50)], "doc_id long, text string")
    _, mates, _ = decontaminate.candidates(docs, like)
    assert mates.count() == 50
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, like).collect()} == {(i, i) for i in range(50)}


def test_clean_rows_that_share_an_id_with_a_match_stay(spark):
    item = prose(40, 77)
    rows = [(i, t) for i in (None, 5) for t in (f"{prose(9, 1)} {item}", prose(50, 3), prose(50, 4), None)]
    left = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(str(r) for r in rows if item not in (r[1] or ""))


def test_empty_tables(spark, docs, empty, clashing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, bench).count() == 0 and decontaminate.decontaminate(docs, bench).count() == docs.count()
    one = spark.createDataFrame([(1, prose(60, 4), "x")], "item_id long, text string, w string")
    assert decontaminate.matches(empty, one).count() == 0
    assert decontaminate.decontaminate(clashing, one).columns == clashing.columns


def test_no_python_in_the_plans(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (decontaminate.matches(docs, bench), mixing.mix(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- pipeline ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = sample_data()
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {"documents": None}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        path = str(root / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_columns_and_filter(spark, stages):
    names = list(stages)
    columns = stages["documents"].columns
    for a, b in zip(names[:3], names[1:4]):
        assert stages[b].columns == columns
        before, after = ({r["doc_id"] for r in stages[k].select("doc_id").collect()} for k in (a, b))
        assert after <= before and len(after) > 0.5 * len(before)
    assert stages["mixing"].columns == columns and stages["tokens"].count() == stages["mixing"].count()


def test_stage_dedup_against_brute_force(spark, stages):
    rows = {r["doc_id"]: r["text"] for r in stages["toxicity"].select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in stages["near_dedup"].select("doc_id").collect()}
    prints = {}
    for d, t in rows.items():
        h = simhash.shingle_hashes(t, 5)
        prints[d] = (simhash.fingerprint(h) & (2**64 - 1)) | (simhash.fingerprint(simhash.second_word(h)) & (2**64 - 1)) << 64
    ids = sorted(prints)
    for i, a in enumerate(ids):
        near = [b for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= simhash.WIDE_RADIUS]
        if a in kept:
            assert not [b for b in near if (prints[a] ^ prints[b]).bit_count() <= 15]
        else:
            assert [b for b in ids if b != a and (prints[a] ^ prints[b]).bit_count() <= simhash.WIDE_RADIUS]


def test_stage_decontamination_against_brute_force(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{sample_data()}/benchmark.parquet").collect()]
    gone = {r["doc_id"]: r["text"] for r in stages["near_dedup"].join(stages["decontamination"], "doc_id", "left_anti").collect()}
    assert all(max(best_window(t, x) for x in items) >= 0.8 for t in gone.values())
    for r in stages["decontamination"].limit(40).collect():
        assert not any(x in r["text"] for x in items)


def test_stage_mixing_counts_words(stages):
    size = Counter()
    for r in stages["decontamination"].collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    taken = Counter()
    longest = Counter()
    for r in stages["mixing"].collect():
        n = len(WORD.findall(r["text"] or ""))
        taken[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for s, t in plain_targets(size).items():
        assert abs(taken[s] - t) <= longest[s] + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = sample_data()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
