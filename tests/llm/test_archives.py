"""WARC archives and token shards: exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from seriesmill.llm import common, tokens, warc

from .conftest import prose, sample_data

PAGES = "page_id long, url string, html string"


def plain_warc(rows):
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        best = max((q for q, _, g in rows if q is not None and (g or "") == (h or "")), default=None)
        again = len(data) >= 1000 and best is not None and (p is None or p < best)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def test_pages(spark):
    big = prose(200, 1)
    rows = [(1, "http://a", big), (2, None, big), (3, "x y", big), (3, "x y", big), (None, "n", big), (4, "e", ""), (5, "e", None), (6, "s", "short"), (7, "s", "short"), (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "l", "z" * 3_000_000), (11, "c", "\r\n\r\nWARC/1.1\r\n\r\n" * 80), (None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == plain_warc(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "a" * 1000, "x", "y"), (2, "u", "a" * 1000, "x", "y")], PAGES + ", payload string, digest string")
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()} == {(1, "revisit", 2), (2, "response", None)}


def test_reader_checks_frames_and_digests():
    one, two = warc.encode(1, "http://x", b"hello" * 50), warc.encode(2, None, b"hello" * 50, 1, True)
    rec = list(warc.read_records(io.BytesIO(one + two)))
    assert [r.kind for r in rec] == ["response", "revisit"] and rec[0].payload == b"hello" * 50 and rec[1].offset == len(one)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    raw = gzip.decompress(one)
    for bad in (raw.replace(b"hello", b"jello", 1), raw[:-1], raw.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(one[:-9])))


def test_reader_works_in_small_pieces():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else 7)

    data = b"".join(warc.encode(i, "u", bytes([i]) * 5000) for i in range(5))
    assert [r.payload for r in warc.read_records(Slow(data))] == [bytes([i]) * 5000 for i in range(5)]


# --- tokens ------------------------------------------------------------------------------------------------


def plain_tokens(rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]


def test_token_table_against_the_library(spark, tokenizer_file):
    from seriesmill.llm import queries

    sf = sample_data()
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_tokens(spark, sf).collect()}
    at = 0
    for d, ids in plain_tokens(rows, tokenizer_file):
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_awkward_documents(docs, awkward, clashing, empty, tokenizer_file):
    got = tokens.token_table(docs, tokenizer_file).collect()
    assert len(got) == len(awkward)
    want = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in plain_tokens([(d, t) for d, t, *_ in awkward], tokenizer_file))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    by = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by] == sorted((d for d, *_ in awkward), key=lambda d: (d is not None, d or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by, by[1:]))
    assert tokens.token_table(empty, tokenizer_file).count() == 0 and tokens.token_table(clashing, tokenizer_file).count() == len(awkward)


def test_word_cache_gives_what_the_library_gives(tokenizer_file):
    from tokenizers import Tokenizer

    tok, own, r = Tokenizer.from_file(tokenizer_file), tokens.WordTokenizer(tokenizer_file, None), random.Random(4)
    alphabet = "abcXYZ019 \t\n.,'-_é́ßÅ漢  🙂\x00<|>Ǆñ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)] + ["", "<|endoftext|>", "don't WON'T it's", "a" * 3000]
    width = {2: "<u2", 4: "<u4"}[own.width]
    for t in texts:
        assert np.frombuffer(own.ids(t), width).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_word_cache_can_be_small(spark, docs, tokenizer_file):
    common.turn_to("tokens", tokens._LOADED.clear)
    own, whole = tokens.tokenizer(tokenizer_file, 1, 50), tokens.WordTokenizer(tokenizer_file)
    texts = [prose(20, i) for i in range(60)]
    for t in texts:
        assert own.ids(t) == whole.ids(t)
        assert len(own.cache) <= 50 + 20
    common.turn_to("simhash")
    plain = tokens.token_table(docs, tokenizer_file).collect()
    assert sorted(tokens.token_table(docs, tokenizer_file, words=50).collect(), key=str) == sorted(plain, key=str)


def test_the_pipeline_keeps_fewer_words_than_the_operator(spark, docs, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    asked = []
    monkeypatch.setattr(tokens, "token_table", lambda *x, words=tokens.WORDS: asked.append(words))
    pipeline.token_shards(spark, docs, "")
    assert len(asked) == 1 and asked[0] < tokens.WORDS


def test_a_worker_that_turns_to_another_operator_lets_go(tokenizer_file):
    common.turn_to("tokens", tokens._LOADED.clear)
    tokens.tokenizer(tokenizer_file).ids("some words")
    common.turn_to("tokens", tokens._LOADED.clear)
    assert tokens._LOADED
    common.turn_to("simhash")
    assert not tokens._LOADED and not common._CACHES


@pytest.mark.parametrize("width", [2, 4])
def test_shard_lookup(tmp_path, width):
    r = random.Random(1)
    w = tokens.ShardWriter(f"file://{tmp_path}", width, {"tokenizer": "t"})
    keys = sorted([None, "", "a", "ab", *(f"doc-{i:05}" for i in range(3000)), *range(-5, 3000, 3), 7, 7], key=tokens.key_bytes)
    rows = [(k, np.array([r.randrange(1 << 16) for _ in range(r.randrange(60))], np.uint32)) for k in keys]
    for k, ids in rows:
        w.add(tokens.key_bytes(k), ids)
    about = w.close()
    s = tokens.ShardReader(about["path"])
    assert s.footer["blocks"] > 3 and s.footer["docs"] == len(rows)
    assert [(tokens.key_value(k), ids.tolist()) for k, _, ids in s.scan()] == [(k, ids.tolist()) for k, ids in rows]
    for k in (None, "", "ab", "doc-01234", 7, -5, 2998):
        assert [x.tolist() for x in s.lookup(k)] == [ids.tolist() for q, ids in rows if q == k and type(q) is type(k)]
    assert s.lookup(8) == [] and s.lookup("zz") == [] and s.lookup(10**9) == []
    assert sum(s.may_hold(f"no-{i}") for i in range(2000)) < 60
    path = about["path"].removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        tokens.ShardReader(about["path"])


def test_keys_sort_like_values():
    keys = [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1, "", "a", "b", "é"]
    raw = [tokens.key_bytes(k) for k in keys]
    assert raw == sorted(raw) and [tokens.key_value(x) for x in raw] == keys
    for n in (0, 1, 127, 128, 1 << 40):
        assert tokens.read_varint(tokens.varint(n), 0)[0] == n
