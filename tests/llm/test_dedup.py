"""SimHash classes and repeated paragraphs against brute force."""

from __future__ import annotations

import functools
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesmill.llm import buckets, components, simhash, substrings
from seriesmill.llm.flat import Words

from .conftest import prose, sample_data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_fingerprint(text, size=4):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) <= size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def plain_components(items, link):
    """items: [(doc_id, x)] -> component id of each row."""
    label = list(range(len(items)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(items)), 2):
        if link(items[i][1], items[j][1]):
            label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(items)):
        groups.setdefault(find(i), []).append(items[i][0])
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(items))]


def test_contract_on_awkward_documents(docs, awkward):
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    items = [(d, plain_fingerprint(t)) for d, t, *_ in awkward]
    comp = plain_components(items, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == sorted((str(d), f, c) for (d, f), c in zip(items, comp))


def test_whole_query_against_brute_force(spark):
    from seriesmill.llm import queries

    sf = sample_data()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, sf).collect()}
    items = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    comp = plain_components(items, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(items, comp)}


def test_every_pair_within_the_radius_meets(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds:
        for k in range(1, 5):
            prints.add(s ^ sum(1 << b for b in r.sample(range(64), k)))
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    comp = {r["node"] & (2**64 - 1): r["component"] & (2**64 - 1) for r in components.connected_components(simhash.fingerprint_links(df, limit=7)).collect()}
    want = plain_components([(i, x) for i, x in enumerate(prints)], lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for x, c in zip(prints, want):
        groups.setdefault(c, []).append(x)
    for g in groups.values():
        if len(g) > 1:
            assert len({comp[x] for x in g}) == 1
    assert len(comp) == sum(len(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("blocks", [simhash.BLOCKS, *simhash.WIDE_BLOCKS])
def test_covering_code(blocks):
    """A partner that differs by at most the threshold in a block has its home among the anchors."""
    rng = np.random.default_rng(1)
    for number, (first, bits, threshold) in enumerate(blocks):
        x = int(rng.integers(0, 1 << 63))
        for flips in itertools.combinations(range(first, first + bits), threshold):
            y = x ^ sum(1 << f for f in flips)
            pair = np.array([x, y], np.uint64).view(np.int64)
            key, index, home = simhash.anchors(pair, blocks)
            of = lambda i, h: {int(k) for k, j, m in zip(key, index, home) if j == i and (m or not h) and k >> 40 == number}  # noqa: B023, E731
            assert len(of(0, True)) == len(of(1, True)) == 1
            assert of(1, True) <= of(0, False)


def test_hot_buckets_are_cut_and_lose_nothing(spark):
    """A large group of close prints, over many chunk pairs."""
    r = random.Random(5)
    base = r.getrandbits(62)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(300)} | {base})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    links = simhash.fingerprint_links(df, limit=20)
    comp = components.connected_components(links)
    assert comp.select("component").distinct().count() == 1 and comp.count() == len(prints)
    assert links.count() < 40 * len(prints)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (5, 4), (4, 4), (None, 9), (7, None), *[(100 + i, 101 + i) for i in range(40)], *[(200, 201 + i) for i in range(50)]]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3), 1), **dict.fromkeys((4, 5), 4), **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(200, 251), 200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame(pairs, "a long, b long"), max_rounds=1)


def test_forest_keeps_components():
    a, b = np.array([1, 2, 3, 9]), np.array([2, 3, 1, 9])
    x, y = buckets.forest(a, b)
    assert sorted(zip(x.tolist(), y.tolist())) == [(2, 1), (3, 1)]


def test_keep_one(docs, awkward, empty, clashing):
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    ids = sorted(str(r["doc_id"]) for r in kept)
    assert "1" in ids and "2" not in ids and ids.count("7") == 1 and "4" in ids and "5" not in ids and "6" not in ids
    assert simhash.keep_one(empty, simhash.near_duplicates(empty)).count() == 0
    out = simhash.keep_one(clashing, simhash.similar_documents(clashing))
    assert out.columns == clashing.columns and 0 < out.count() < len(awkward)


def test_keep_one_leaves_unrelated_rows_with_null_or_repeated_ids(spark):
    rows = [(None, prose(80, 50 + k)) for k in range(4)] + [(7, prose(80, 60 + k)) for k in range(3)] + [(None, prose(80, 50)), (9, prose(80, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for find in (simhash.near_duplicates, simhash.similar_documents):
        kept = [tuple(r) for r in simhash.keep_one(df, find(df)).collect()]
        assert sorted(kept, key=str) == sorted(set(rows) - {(9, prose(80, 60))}, key=str)


@functools.cache
def shingle_set(t, n=5):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    if not 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)):
        return 0.0 if x.isdisjoint(y) else len(x & y) / len(x | y)
    return len(x & y) / len(x | y)


def test_similar_documents_at_08(spark):
    """Copies with few edits are one class; texts that share a part only aren't."""
    r = random.Random(2)
    rows, near, far = [], [], []
    for k in range(30):
        w = prose(300, 1000 + k).split()
        edited = list(w)
        for i in r.sample(range(300), 4):
            edited[i] = "changed" + str(i)
        other = w[:100] + prose(200, 9000 + k).split()
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(edited)), (3 * k + 2, " ".join(other))]
        near.append(jaccard(rows[-3][1], rows[-2][1]))
        far.append(jaccard(rows[-3][1], rows[-1][1]))
    assert min(near) > 0.85 and max(far) < 0.5
    comp = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(comp[3 * k + 1] == 3 * k for k in range(30)) >= 27
    assert all(comp[3 * k + 2] == 3 * k + 2 for k in range(30))


def test_similarity_is_exact_at_the_threshold(spark):
    """Pairs just above 0.8 are linked, all of them; pairs just below aren't, and chain nothing."""
    rows, similar = [], {}
    for k in range(60):
        w = prose(300, 20_000 + k).split()
        n = 32 if k % 2 else 40  # of 296 shingles n go and n come
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-n], *(f"new{i}" for i in range(n))]))]
        similar[2 * k + 1] = jaccard(rows[-2][1], rows[-1][1])
    assert 0.7 < min(similar.values()) < 0.8 <= min(s for d, s in similar.items() if d // 2 % 2) < 0.81
    w = prose(400, 3).split()  # a chain over a hot bucket: neighbours are similar, ends aren't
    rows += [(1000 + i, " ".join(w[4 * i : 4 * i + 200])) for i in range(30)]
    comp = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), limit=5).collect()}
    assert {d for d, s in similar.items() if comp[d] == d - 1} == {d for d, s in similar.items() if s >= 0.8}
    assert all(comp[d] == 1000 for d in range(1000, 1030))


def test_every_pair_within_eleven_of_128_bits_meets(spark):
    """The anchors of the wide prints, over chunk pairs as well; prints that nothing is near meet nothing."""
    r, pairs, rows = random.Random(4), [], []
    for k in range(80):
        x = r.getrandbits(128)
        for y in (x, x ^ (1 << k % 64) ^ sum(1 << b for b in r.sample(sorted({*range(128)} - {k % 64}), 10 if k % 2 else k % 11))):
            rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (y & (2**64 - 1), y >> 64)))
        pairs.append(frozenset((rows[-2][0], rows[-1][0])))
    for limit in (2000, 2):
        found = simhash.anchored_pairs(spark.createDataFrame(rows, "low long, high long"), limit)
        assert {frozenset((x["a"], x["b"])) for x in found.collect()} == set(pairs)


@pytest.mark.parametrize("limit", [2000, 60])
def test_a_large_group_of_near_texts_makes_no_table_of_pairs(spark, limit):
    """Edits of one text, similar to some others of them and not to most: classes as by brute force, few rows."""
    r, w, rows = random.Random(6), prose(150, 77).split(), []
    for i in range(240):
        edits = set(r.sample(range(150), r.randrange(12)))
        rows.append((i, " ".join(f"e{i}x{k}" if k in edits else x for k, x in enumerate(w))))
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.wide_fingerprints(df, 5).dropDuplicates(["fp"])
    assert 200 < simhash.banded_pairs(prints, limit).count() < 20 * 240
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(df, limit=limit).collect()}
    want = plain_components(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert [got[d] for d, _ in rows] == want and 20 < len(set(want)) < 200


# --- passages ----------------------------------------------------------------------------------------------


def plain_stretches(rows, n=substrings.PASSAGE):
    """Brute force: {(doc, text): spans of words} of all runs of n words that another text holds as well."""
    seen, words = {}, {}
    for d, t in {(d, t) for d, t in rows if t}:
        words[d, t] = [x.encode() for x in WORD.findall(lower(t))]
        for i in range(len(words[d, t]) - n + 1):
            seen.setdefault(tuple(words[d, t][i : i + n]), set()).add(t)
    out = {}
    for (d, t), w in words.items():
        held = [False] * len(w)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                held[i : i + n] = [True] * n
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in held))]
        if spans:
            out[d, t] = spans
    return out


def plain_passages(rows, n=substrings.PASSAGE):
    """Brute force: lines of the shortest runs of n words from each line on whose classes stand in two texts."""
    texts = sorted({t for _, t in rows if t})
    lines = {t: [x for x in t.split("\n") if WORD.findall(x)] for t in texts}
    every = sorted({x for v in lines.values() for x in v})
    comp = dict(zip(every, plain_components([(x, x) for x in every], lambda a, b: jaccard(a, b) >= 0.8)))
    owners, runs = {}, []
    for t, own in lines.items():
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(len(WORD.findall(x)) for x in own[i:j]) >= n:
                    for stop in range(j, min(j + 1, len(own)) + 1):
                        key = tuple(comp[x] for x in own[i:stop])
                        owners.setdefault(key, set()).add(t)
                        runs.append((t, i, stop, key))
                    break
    return {(t, p) for t, i, stop, key in runs if len(owners[key]) > 1 for p in range(i, stop)}


def said(found, rows):
    """{(doc, text): words of each stretch} of rows of kind run; every row's words are counted."""
    by_key = {}
    for r in found:
        if r["part"] == "run":
            by_key.setdefault((r["doc_id"], r["text_key"]), []).append(r)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    out = {}
    for (d, _), parts in by_key.items():
        fits = [t for t in texts[d] if t and all(len(t[x["start"] : x["end"]].split()) == x["n_words"] for x in parts)]
        covered = lambda t: [any(x["start"] <= m.start() and m.end() <= x["end"] for x in parts) for m in WORD.finditer(t)]  # noqa: B023, E731
        t = fits[0]
        out[d, t] = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in covered(t)))]
    return out


def leads(rows):
    """Of documents with equal texts the first one: its rows hold the stretches."""
    first = {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(t, d)
    return {(d, t) for t, d in first.items()}


def test_passages_on_awkward_documents(spark, docs, awkward):
    rows = [(d, t) for d, t, *_ in awkward]
    found = substrings.repeated(docs).collect()
    assert said(found, rows) == {k: v for k, v in plain_stretches(rows).items() if k in leads(rows)}
    whole = {(r["doc_id"], r["removed"]) for r in found if r["part"] == "text"}
    assert whole == {(1, False), (2, True), (None, True)}


def test_passages_against_brute_force(spark):
    from seriesmill.llm import queries

    sf = sample_data().replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op1_substrings(spark, sf).collect()
    want = plain_stretches(rows)
    assert said(found, rows) == {k: v for k, v in want.items() if k in leads(rows)}
    hit = {r["doc_id"] for r in found}
    copied = {d for d, t in rows if len(WORD.findall(t or "")) >= 51 and sum(t == u for _, u in rows) > 1}
    assert {d for d, _ in want} | copied <= hit
    assert {r["doc_id"] for r in found if r["part"] == "text"} == copied


def test_paragraphs_against_brute_force(spark):
    """Lines of passages of similar lines are rows, if they don't lie in a stretch; no other line is."""
    from seriesmill.llm import queries

    sf = sample_data()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    texts, of, want = dict(rows), {t: d for d, t in leads(rows)}, plain_stretches(rows)
    like = {(r["doc_id"], r["para"]) for r in queries.op1_substrings(spark, sf).collect() if r["part"] == "line"}
    outside = set()
    for t, p in plain_passages(list(leads(rows))):
        lines = [m for m in re.finditer(r"[^\n]+", t) if WORD.search(m.group())]
        inside = [i for i, m in enumerate(WORD.finditer(t)) if lines[p].start() <= m.start() and m.end() <= lines[p].end()]
        if not any(a <= inside[0] and inside[-1] < b for a, b in want.get((of[t], t), ())):
            outside.add((of[t], p))
    assert all(texts[d] for d, _ in like) and like == outside


def test_passages_inside_long_lines(spark):
    """Every run of 51 words is found wherever it stands, to its last word; nothing shorter is."""
    r, rows = random.Random(9), []
    for k in range(40):
        passage = prose((51, 52, 60, 50, 30)[k % 5], 300 + k)
        for side in range(2):
            before, after = prose(r.randrange(20, 150), 7000 + 2 * k + side), prose(r.randrange(20, 150), 8000 + 2 * k + side)
            rows.append((2 * k + side, f"{before} {passage} {after}"))
    rows += [(900, "same " * 300), (901, "x " + "same " * 300), (902, prose(60, 98).replace("a", "é") + " " + prose(55, 1)), (903, prose(60, 99).replace("a", "ü") + " " + prose(55, 1).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated(df).collect()
    assert said(found, rows) == plain_stretches(rows)
    texts = dict(rows)
    for x in found:
        if x["doc_id"] < 80:
            assert x["removed"] == (x["doc_id"] % 2 == 1) and x["n_words"] in (51, 52, 60)
            assert lower(texts[x["doc_id"]][x["start"] : x["end"]]) in lower(texts[x["doc_id"] ^ 1])
    mates = {}
    for x in found:
        mates.setdefault(x["class_id"], set()).add(x["doc_id"])
    assert sorted(map(sorted, mates.values())) == sorted([[2 * k, 2 * k + 1] for k in range(40) if k % 5 < 3] + [[900, 901], [902, 903]])
    cut = {x["doc_id"]: x["text"] for x in substrings.remove(df).collect()}
    assert cut[0] == texts[0] and len(cut[1].split()) == len(texts[1].split()) - 51


def test_passages_across_line_ends(spark):
    """Runs of 51 words that begin and end inside short lines, or are broken over lines differently."""
    own = lambda k: prose(10, 40_000 + k)
    cut = lambda k, *at: "\n".join(" ".join(prose(70, 500 + k).split()[a:b]) for a, b in zip((0, *at), (*at, 70)))
    rows = [(0, f"{own(0)} {cut(0, 25)} {own(1)}"), (1, f"{own(2)} {cut(0, 25)} {own(3)}"), (2, f"{own(4)} {cut(1, 15, 54)} {own(5)}"), (3, f"{own(6)}\n\n{cut(1, 15, 54)} {own(7)}")]
    rows += [(4, cut(2)), (5, cut(2, 12, 24, 36, 48, 60)), (6, own(8) + "\n" + own(9)), (7, f"{cut(3, 30)}\n{own(10)}"), (8, f"{own(11)}\n{cut(3, 30)}")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    texts, found = dict(rows), substrings.repeated(df).collect()
    assert {(x["doc_id"], x["n_words"], x["part"], x["removed"]) for x in found} == {(d, 70, "run", d in (1, 3, 5, 8)) for d in (0, 1, 2, 3, 4, 5, 7, 8)}
    assert said(found, rows) == plain_stretches(rows)
    left = {x["doc_id"]: x["text"] for x in substrings.remove(df).collect()}
    assert all(left[d] == texts[d] for d in (0, 2, 4, 6, 7)) and all(len(left[d].split()) == len(texts[d].split()) - 70 for d in (1, 3, 5, 8))


def test_similar_paragraphs(spark):
    """Passages of lines that are similar but nowhere equal over 51 words; lone similar lines aren't passages."""
    edit = lambda t, *at: " ".join("edit" if i in at else w for i, w in enumerate(t.split()))
    a, b, c, d = (prose(n, 70 + n) for n in (40, 41, 30, 45))
    rows = [(1, f"{a}\n{b}\nown end one"), (2, f"first words\n{edit(a, 39)}\n{edit(b, 40)}"), (3, c + "\n" + prose(40, 1)), (4, c + "\n" + prose(40, 2)), (5, edit(d, 44)), (6, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated(df).collect()
    assert {(x["doc_id"], x["para"], x["removed"], x["part"]) for x in found} == {(1, 0, False, "line"), (1, 1, False, "line"), (2, 1, True, "line"), (2, 2, True, "line")}
    assert {(lower(t), p) for t, p in plain_passages(rows)} == {(lower(dict(rows)[x["doc_id"]]), x["para"]) for x in found}
    assert {x["doc_id"]: x["text"] for x in substrings.remove(df, substrings.repeated(df)).collect()}[2] == "first words"


def test_stretches_are_cut_where_an_earlier_document_ends(spark):
    """Two passages of different documents side by side in a third: one stretch, removed but for what is its own."""
    x, y, z = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, f"{x} {prose(30, 4)}"), (2, f"{x} {y} {z}"), (3, f"{prose(30, 5)} {y}"), (4, z), (5, f"{prose(30, 6)} {z} {x}")]
    found = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {d: [(r["n_words"], r["removed"]) for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] == d] for d in range(1, 6)}
    assert got == {1: [(60, False)], 2: [(60, True), (120, False)], 3: [(60, True)], 4: [(60, True)], 5: [(120, True)]}
    assert len({r["class_id"] for r in found}) == 1


def test_windows_are_those_of_plain_winnowing():
    texts = [prose(200, 5), "", prose(39, 6), prose(40, 7), prose(45, 8), prose(51, 9), "a b"]
    w = Words([t.encode() for t in texts])
    at, keys = substrings.kept_windows(w)
    held = dict(zip(at.tolist(), keys.view(np.uint64).tolist()))
    want = {}
    for first, stop in zip(w.first[:-1], w.first[1:]):
        v = {i: int(w.runs(np.array([i]), np.array([i + 40]))[0]) for i in range(first, stop - 39)}
        for i in v:
            group = [k for k in range(i, i + 12) if k in v]
            if len(group) == 12 or i == first:
                best = min(group, key=v.get)
                want[best] = v[best]
    assert held == want


def test_hashes_of_words():
    texts = ["Hello wörld  a\nb", "", "  ", "x", "Hello WÖRLD", "a b c d e f", " lead", "trail "]
    w = Words([t.encode() for t in texts])
    got = [[] for _ in texts]
    for s, e, t in zip(w.start, w.end, w.text):
        got[t].append(bytes(w.data[s:e]))
    assert got == [t.encode().lower().split() for t in texts] and [len(g) for g in got] == list(np.diff(w.first))
    assert w.hash[0] == w.hash[w.first[4]] and len(set(w.hash.tolist())) == len({x for g in got for x in g})
    two = w.runs(np.array([w.first[5], w.first[0] + 2]), np.array([w.first[5] + 2, w.first[0] + 4]))
    assert two[0] == two[1]  # a b


def test_removal_leaves_the_first_copy(spark, empty, clashing):
    p = prose(60, 8)
    df = spark.createDataFrame([(1, f"{p}\nown line one"), (2, f"start\n{p}"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"].strip() if r["text"] else None for r in substrings.remove(df).collect()}
    assert out == {1: f"{p}\nown line one", 2: "start", 3: "nothing here", 4: None}
    assert substrings.repeated(empty).count() == 0 and substrings.remove(empty).count() == 0
    assert substrings.remove(clashing).columns == clashing.columns
    found = substrings.repeated(df)
    assert {(r["doc_id"], r["removed"]) for r in found.collect()} == {(1, False), (2, True)}


def test_large_bucket_of_near_lines(spark):
    """Many near copies of one line, above the bucket limit."""
    w = prose(60, 12).split()
    rows = [(i, " ".join([*w[: i % 60], f"e{i}", *w[i % 60 + 1 :]])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = substrings.line_links(substrings.parsed(df), df, limit=20)
    comp = components.connected_components(links)
    texts = [t for _, t in rows]
    want = plain_components([(i, t) for i, t in enumerate(texts)], lambda a, b: jaccard(a, b) >= 0.8)
    assert len(set(want)) == 1 and comp.select("component").distinct().count() == 1 and comp.count() == 150


def test_extra_columns_do_not_matter(docs, clashing):
    a = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id")
    b = simhash.near_duplicates(clashing).select("doc_id", "fp", "component_id")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert substrings.repeated(clashing).count() == substrings.repeated(docs).count()
    assert a.where(F.col("doc_id").isNull()).count() == 2
