"""Token ids of documents in sorted-string-table shards.

A shard is one file: data blocks of entries in key order, then a sparse index, a Bloom filter and a footer.

    header   b"SMSST001"
    block    zlib(entries) of about BLOCK_BYTES, with every entry as
             varint shared | varint rest | varint value bytes | rest of the key | value
             where `shared` is the number of bytes that the key has in common with the entry before it in the block
    value    varint token count | ids, little-endian, of the width that the footer names
    index    for every block: last key, file offset, bytes on disk, documents and ids before it in the shard
    Bloom    bits for every key, HASHES double-hashed probes
    footer   JSON (places of index and Bloom filter, counts, key range, id width, tokenizer), its length, b"SMSSTEND"

Keys: integers as nine bytes that sort like the numbers, strings as UTF-8 behind a tag, a null as the tag alone
(first). A reader takes the footer, asks the Bloom filter, finds the block in the index by binary search and decodes
that block only; a scan streams through the blocks.

Rows are dealt by ranges of (doc_id, hash of text): also rows that repeat one id spread over several shards. Shards
are written under a name of their own and moved into place when complete; a manifest table names those of successful
tasks, so that lost executors and repeated attempts leave no rows twice.

Defined results: a null text is an empty one and holds the end id alone; rows that repeat a doc_id are kept and follow
each other in the order of their texts' hashes; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ShardFile, materialise, new_path, open_fs, small_batches, turn_to

HEAD, TAIL = b"SMSST001", b"SMSSTEND"
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 256 << 20
HASHES, BITS_A_KEY = 7, 10


# --- encoding ----------------------------------------------------------------------------------------------


def key_bytes(key) -> bytes:
    if key is None:
        return b"\x00"
    if isinstance(key, str):
        return b"\x02" + key.encode("utf-8")
    return b"\x01" + struct.pack(">Q", (int(key) + (1 << 63)) & ((1 << 64) - 1))


def key_value(raw: bytes):
    if raw[:1] == b"\x00":
        return None
    if raw[:1] == b"\x02":
        return raw[1:].decode("utf-8")
    return struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Takes (key, ids) in ascending key order."""

    def __init__(self, folder: str, width: int, about: dict):
        self.file = ShardFile(folder, ".sst")
        self.width, self.about = width, about
        self.file.write(HEAD)
        self.block, self.last, self.block_size = [], b"", 0
        self.index, self.keys = [], []
        self.docs = self.ids = self.block_docs = self.block_ids = 0
        self.first: bytes | None = None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            for x, y in zip(self.last, key):
                if x != y:
                    break
                shared += 1
        value = varint(len(ids)) + ids.astype(f"<u{self.width}").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.first = key if self.first is None else self.first
        self.last = key
        self.keys.append(xxhash.xxh3_128_digest(key))
        self.docs += 1
        self.ids += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append((self.last, self.file.size, len(data), self.block_docs, self.block_ids))
            self.file.write(data)
            self.block, self.block_size = [], 0
            self.block_docs, self.block_ids = self.docs, self.ids

    def close(self) -> dict:
        self._flush()
        index = b"".join(varint(len(k)) + k + b"".join(map(varint, rest)) for k, *rest in self.index)
        place = self.file.size
        self.file.write(index)
        bits = max(64, BITS_A_KEY * self.docs)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        if self.keys:
            h = np.frombuffer(b"".join(self.keys), ">u8").astype(np.uint64).reshape(-1, 2)
            high, low = h[:, 0] | np.uint64(1), h[:, 1]
            for k in range(HASHES):
                p = self._mod(low, high, k, bits)
                np.bitwise_or.at(bloom, (p >> 3).astype(np.int64), (1 << (p & 7)).astype(np.uint8))
        self.file.write(bloom.tobytes())
        footer = self.about | {"index": [place, len(index)], "bloom": [place + len(index), len(bloom), bits], "blocks": len(self.index), "docs": self.docs, "ids": self.ids, "width": self.width, "first": (self.first or b"").hex(), "last": self.last.hex()}
        raw = json.dumps(footer).encode()
        self.file.write(raw + struct.pack("<I", len(raw)) + TAIL)
        return {"path": self.file.commit(), "docs": self.docs, "ids": self.ids, "first": self.first, "last": self.last, "bytes": self.file.size}

    @staticmethod
    def _mod(low: np.ndarray, high: np.ndarray, k: int, bits: int) -> np.ndarray:
        m = np.uint64(bits)
        return (low % m + np.uint64(k) * (high % m)) % m


class ShardReader:
    """Binary-search lookup and streaming scan of one shard."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.size = fs.get_file_info(path).size
        self.f = fs.open_input_file(path)
        tail = self._at(self.size - 12, 12)
        if tail[4:] != TAIL or self._at(0, 8) != HEAD:
            raise ValueError(f"not a complete shard: {uri}")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._at(self.size - 12 - n, n))
        self._index = self._bloom = None

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    @property
    def index(self) -> list[tuple]:
        if self._index is None:
            data, at, out = self._at(*self.footer["index"]), 0, []
            while at < len(data):
                n, at = read_varint(data, at)
                key, at = data[at : at + n], at + n
                rest = []
                for _ in range(4):
                    x, at = read_varint(data, at)
                    rest.append(x)
                out.append((key, *rest))
            self._index = out
        return self._index

    def may_hold(self, key) -> bool:
        place, n, bits = self.footer["bloom"]
        if self._bloom is None:
            self._bloom = self._at(place, n)
        h = xxhash.xxh3_128_digest(key_bytes(key))
        high, low = int.from_bytes(h[:8], "big") | 1, int.from_bytes(h[8:], "big")
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in ((low % bits + k * (high % bits)) % bits for k in range(HASHES)))

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n, _, _ = self.index[block]
        data, at, key, width = zlib.decompress(self._at(offset, n)), 0, b"", self.footer["width"]
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            count, begin = read_varint(data, at)
            yield key, np.frombuffer(data, f"<u{width}", count, begin)
            at += size

    def lookup(self, key) -> list[np.ndarray]:
        """The ids of every document of this key."""
        if not self.footer["docs"] or not self.may_hold(key):
            return []
        raw, found = key_bytes(key), []
        b = bisect_left([e[0] for e in self.index], raw)
        while b < len(self.index):
            for k, ids in self.entries(b):
                if k > raw:
                    return found
                if k == raw:
                    found.append(ids)
            b += 1
        return found

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of every document."""
        start = 0
        for b in range(len(self.index)):
            for key, ids in self.entries(b):
                yield key, start, ids
                start += len(ids)


# --- tokenizing --------------------------------------------------------------------------------------------


#: Words that a worker's cache may hold; 919,000 took 254 MB, with their pieces.
WORDS = 1_000_000


class WordTokenizer:
    """Whole texts to ids, with a cache of words.

    The file's tokenizer drops white space and never merges across it, so a text's ids are those of its words. Words
    made of ASCII and Latin letters up to U+024F are cut here by the rules that the file states and given to its merge
    model; any other word, and one with a marker like <|endoftext|> that the tokenizer knows, goes through the whole
    tokenizer. The cache is dropped when it holds `most` words.
    """

    def __init__(self, path: str, end: int | None = 1, most: int = WORDS):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.end = b"" if end is None else int(end).to_bytes(self.width, "little")
        self.merge, self.most, self.cache, self.pieces = self.whole.model.tokenize, most, {}, {}
        self.plain = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-įĲ-ľŁ-ňŊ-ž]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kinds = [x["type"] for x in rules["normalizer"]["normalizers"]], [x["type"] for x in rules["pre_tokenizer"]["pretokenizers"]]
        pattern = rules["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        self.known = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pattern == self.cut.pattern
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b) if b in printable else None for b in range(256)}
        self.letters = {b: c or chr(next(rest)) for b, c in self.letters.items()}

    def _pack(self, ids) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            out = self.pieces[piece] = self._pack([t.id for t in self.merge(mapped)])
        return out

    def word(self, word: str) -> bytes:
        if self.known and self.plain.fullmatch(word) and not any(m in word.lower() for m in self.marks):
            return b"".join(map(self._piece, self.cut.findall(word.lower())))
        return self._pack(self.whole.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        """Ids of the text and the end id, little-endian."""
        words = _split(text or "")
        get = self.cache.get
        found = list(map(get, words))
        if None in found:
            if len(self.cache) > self.most:
                self.cache.clear()
                self.pieces.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    x = get(w)
                    if x is None:
                        x = self.cache[w] = self.word(w)
                    found[i] = x
        found.append(self.end)
        return b"".join(found)


def _split(text: str) -> list[str]:
    """Words between ASCII white space only; other white space stays inside and is left to the tokenizer."""
    if text.isascii() or not any(c in text for c in "\x85\xa0                　"):
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]


_LOADED: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, end: int | None = 1, most: int = WORDS) -> WordTokenizer:
    """One tokenizer and cache per worker process."""
    if (path, end, most) not in _LOADED:
        _LOADED[path, end, most] = WordTokenizer(path, end, most)
    return _LOADED[path, end, most]


# --- Spark -------------------------------------------------------------------------------------------------

MANIFEST = "path string, docs long, ids long, first binary, last binary, bytes long"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int | None = 1, shard_bytes: int = SHARD_BYTES, shards: int | None = None, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> manifest of shards in ascending doc_id order, with `start`, the ids before each."""
    spark = docs.sparkSession
    small_batches(spark)

    def work(batches):
        turn_to("tokens", _LOADED.clear)
        tok = tokenizer(tokenizer_path, end, words)
        kind, about = f"<u{tok.width}", {"tokenizer": tokenizer_path.rsplit("/", 1)[-1], "end": end}
        out, done = None, []
        for b in batches:
            for key, text in zip(b.column("doc_id"), b.column("text")):
                if out is None:
                    out = ShardWriter(folder, tok.width, about)
                out.add(key_bytes(key.as_py()), np.frombuffer(tok.ids(text.as_py()), kind))
                if out.file.size >= shard_bytes:
                    done, out = [*done, out.close()], None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("bytes", pa.int64())]))

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
    made = materialise(rows.select("doc_id", "text").mapInArrow(work, MANIFEST), "manifest")
    # One row a shard of up to shard_bytes: small whatever the input. Shards that share a key keep one fixed order.
    before = W.orderBy("first", "last", "path").rowsBetween(W.unboundedPreceding, -1)
    return made.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """Stream the shards of a manifest: (doc_id, start, n_tokens, ids_crc32) of every document."""

    def work(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows = []
                for key, before, ids in ShardReader(path).scan():
                    rows.append((key_value(key), start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows, kind)
                        rows = []
                yield _batch(rows, kind)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(work, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list, kind: str) -> pa.RecordBatch:
    ids, *rest = zip(*rows) if rows else ((), (), (), ())
    types = {"string": pa.string(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(ids, types.get(kind, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(docs: DataFrame, tokenizer_path: str, end: int | None = 1, folder: str | None = None, words: int = WORDS) -> DataFrame:
    """Write the shards of docs, read them back; words: how many a worker's cache may hold."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string" if kind == "string" else "long"))
    folder = folder or new_path(docs.sparkSession, "shards")
    return read(write(docs, folder, tokenizer_path, end, words=words), "string" if kind == "string" else "long")
