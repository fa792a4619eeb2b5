"""Scoring texts with a byte model by context-tree weighting, beside a unigram baseline.

The model's text is what the baseline counts: the words, lower-cased (A-Z), each with one blank behind it, and one end
symbol (byte 0xFF, which UTF-8 never has). A byte is coded as eight binary decisions. The context of a decision is the
bits of the byte so far and the bytes before it, word after word: DEPTH symbols, the SINGLE nearest bytes and beyond them
pairs of bytes (each by its lower four bits), so that a context reaches SPAN bytes back, or to the last two bytes of the
word before. Every node of the context tree keeps how often the training text decided 0 and 1 there; a node's
Krichevsky-Trofimov probability P_e is weighted against the product of its children's: P_w = P_e / 2 + prod
P_w(children) / 2. With all counts fixed, a decision's probability is the mixture over all depths that these weights
imply; below the last node that training has seen it is one half, as for any unseen node. A text's score is the log10
probability of all its bytes, so it can be set against the baseline's.

A unit is a word with its blank (or the end symbol) behind the three bytes before it: the last two of the word before
(blank where it has one only) and its blank; 0, 0 and a line feed at the beginning of a text. All that the contexts of
its bytes can hold stands in a unit, so units that repeat in a chunk of texts are scored once.

Everything scales with the corpus and nothing of its size is broadcast. Texts are taken in chunks, neighbouring rows of
one file split. A chunk asks for its byte grams, each once with its count in training rows, and for its words: sorted
and compressed blocks of bytes, one for each part of the tree. The tree is cut into subtrees by the last two context
bytes and dealt out by them; only the two upper levels (at most 256 * 255 nodes) pass through the driver. A part answers
a block with another one that holds just the probabilities, in the order of the question. The chunk is then read again,
which gives the same grams in the same order (a check value of each block holds it to that), and looks them up.

Baseline: words lower-cased (A-Z) and one end per text; sum of log10((c + 1) / (N + V + 1)) over a text's tokens.

Defined results: a null text is an empty one (one end symbol, one end token); rows are kept one for one whatever
doc_id holds (null counts as the text 'null' for the held-out rule); without training rows every count is 0, every
bit has probability one half, and N = V = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_bucket, materialise, new_path, open_fs, remove, small_batches
from .flat import Words, chunks, mixed

DEPTH, SINGLE = 7, 4
#: Bytes before a byte that its context reaches back.
SPAN = SINGLE + 2 * (DEPTH - SINGLE)
CLASSES = (7, 2)  # held out: crc32(doc_id as text) mod 7 is 2
END = b"\xff"
#: Bytes of text in a chunk, or one larger text.
_CHUNK = 16 << 20
#: Units whose grams are told at a time.
_UNITS = 200_000
#: Lets Spark delete a job's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Grams of subtrees that are worked on at a time, about, or one larger subtree.
_SUBTREE = 1 << 16


#: Bytes before a unit that it carries along, and what they are at the beginning of a text.
BEFORE, _BEGIN = 3, np.array([0, 0, 10], np.uint8)


def binary_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array over one buffer of bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, sizes) of a binary array without nulls."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def units(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts, number of units of each text), without a loop over units."""
    w = Words(texts)
    n, size = len(w.start), w.end - w.start
    at = np.arange(n) + w.text  # of the words among the units; each text before has one end more
    ends = w.first[1:] + np.arange(len(texts))
    length = np.empty(n + len(texts), np.int64)
    length[at], length[ends] = size + BEFORE + 1, BEFORE + 1
    head = np.cumsum(length) - length
    out = np.full(int(length.sum()), 0x20, np.uint8)
    mine = np.repeat(head[at] + BEFORE - w.start, size)
    byte = np.arange(int(size.sum())) + np.repeat(w.start - (np.cumsum(size) - size), size)
    out[mine + byte] = w.data[byte]
    out[head[ends] + BEFORE] = END[0]
    # The last two bytes of the word before; a word of one byte leaves the blank.
    follows = head[at] + length[at]
    out[follows + 1] = w.data[w.end - 1] if n else 0
    long = size > 1
    out[follows[long]] = w.data[w.end[long] - 2]
    first = np.append(0, ends[:-1] + 1)[: len(texts)]
    out[head[first][:, None] + np.arange(BEFORE)] = _BEGIN
    return binary_array(out, length), np.diff(w.first) + 1


def tokens(batch: pa.Array) -> np.ndarray:
    """Keys of the baseline's tokens in units: a sum of 64-bit words, one for each byte and place of the word; 0 for the end."""
    data, sizes = flat_bytes(batch)
    size = sizes - BEFORE - 1
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = data[place + np.repeat(np.cumsum(sizes) - sizes + BEFORE, size)]
    out = np.zeros(len(sizes), np.uint64)
    some = size > 0
    if some.any():
        found = np.add.reduceat(mixed((place.astype(np.uint64) << np.uint64(8) | byte) + np.uint64(1)), first[some])
        out[some] = np.maximum(found, np.uint64(1))
    return out


# --- the tree ----------------------------------------------------------------------------------------------


_SMALL = 1 << 16


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma for large x."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _from_counts(first: float) -> np.ndarray:
    """log Gamma(k + first) for k below _SMALL, from log Gamma(first) on."""
    start = 0.5 * np.log(np.pi) if first == 0.5 else 0.0
    return np.concatenate([[start], start + np.cumsum(np.log(np.arange(_SMALL - 1) + first))])


_HALF, _ONE = _from_counts(0.5), _from_counts(1.0)


def log_gamma(n: np.ndarray, table: np.ndarray, first: float) -> np.ndarray:
    """log Gamma(n + first) of whole numbers n."""
    at = np.minimum(n, _SMALL - 1).astype(np.int64)
    out = table[at]
    large = n >= _SMALL
    if large.any():
        out[large] = _stirling(n[large] + first)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0, _HALF, 0.5) + log_gamma(n1, _HALF, 0.5) - log_gamma(n0 + n1, _ONE, 1.0) - np.log(np.pi)


def grams(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte of every coded byte of the units, index of its unit); the nearest context byte is the lowest.

    Context symbols are the SINGLE nearest bytes, and beyond them pairs of bytes, each by its lower four bits.
    """
    data, sizes = flat_bytes(batch)
    each = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.zeros(len(data) + SPAN * (len(sizes) + 1), np.int64)
    flat[np.arange(len(data)) + SPAN * (each + 1)] = data
    pairs = flat & 15
    pairs[1:] |= (flat[:-1] & 15) << 4
    of = np.repeat(np.arange(len(sizes)), sizes - BEFORE)
    at = np.arange(len(of)) + (of + 1) * (SPAN + BEFORE)
    out = flat[at]
    for k in range(1, DEPTH + 1):
        out |= (flat[at - k] if k <= SINGLE else pairs[at - SINGLE - 2 * (k - SINGLE) + 1]) << (8 * k)
    return out, of


def bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the eight decisions of each gram's byte: node (1..255, the bits before it) and bit, as (8, n) arrays."""
    byte = gram & 255
    j = np.arange(8)[:, None]
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; there is at least one key."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


class Subtrees:
    """Nodes of depth TOP and deeper over different grams with training counts (0 for grams that are only asked for).

    A node without counts has P_w = 1, so it changes no other, and gives one half as any unseen node does. Nodes of one
    depth are sorted by the bits so far, then by the context from the nearest byte on: those of one parent are side by
    side, so sums go up and probabilities go down by runs, without a search. Trees of different bits so far share no
    node, so the decisions of a large subtree may be taken one by one.
    """

    TOP = 2

    def __init__(self, gram: np.ndarray, n: np.ndarray, decisions: slice = slice(8)):
        node, self.bit = (x[decisions] for x in bits(gram))
        context = gram.view(np.uint64).byteswap() & np.uint64((1 << 56) - 1)
        key = ((node.astype(np.uint64) << np.uint64(56)) | context[None, :]).ravel()
        by = np.arange(len(gram)) if (context[1:] >= context[:-1]).all() else np.argsort(context)
        # Decisions come one after another, and so do their nodes; the sort of bytes keeps contexts in order.
        order = np.concatenate([j * len(gram) + by[np.argsort(x[by].astype(np.uint8), kind="stable")] for j, x in enumerate(node)])
        key, one = key[order], self.bit.ravel()[order]
        count = np.tile(n.astype(float), len(node))[order]
        first = _runs(key)
        self.leaf = np.empty(len(order), np.int64)
        self.leaf[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        n0, n1 = np.add.reduceat(count * (1 - one), first), np.add.reduceat(count * one, first)
        self.key, self.below = key[first], log_kt(n0, n1)
        #: For each depth from the deepest up: the weight of a node's own estimate, that estimate, and parents in the next one.
        self.levels = [(np.ones(len(n0)), (n1 + 0.5) / (n0 + n1 + 1), None)]
        for d in range(DEPTH - 1, self.TOP - 1, -1):
            key = self.key >> np.uint64(8) if d < DEPTH - 1 else self.key >> np.uint64(8 * (8 - DEPTH))
            first = _runs(key)
            self.levels[-1] = (*self.levels[-1][:2], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key)))))
            n0, n1, below = (np.add.reduceat(x, first) for x in (n0, n1, self.below))
            own = log_kt(n0, n1)
            self.key, self.below = key[first], np.logaddexp(own, below) - np.log(2)
            self.levels.append((1 / (1 + np.exp(np.clip(below - own, -700, 700))), (n1 + 0.5) / (n0 + n1 + 1), None))
        self.n0, self.n1 = n0, n1

    def sums(self) -> tuple:
        """(nearest byte, bits so far, n0, n1, sum of log P_w) of the nodes above, as far as they lie here."""
        key = self.key >> np.uint64(8)
        first = _runs(key)
        key = key[first].astype(np.int64)
        return (key & 255, key >> 8, *(np.add.reduceat(x, first) for x in (self.n0, self.n1, self.below)))

    def log_probability(self, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 probability of each gram's byte in its context, given what crown() says of the nodes above."""
        at = (self.key >> np.uint64(8)).astype(np.int64)
        p, rest = top[0][at & 255, at >> 8], top[1][at & 255, at >> 8]
        for k, (weight, one, _) in enumerate(reversed(self.levels)):
            if k:
                parent = self.levels[len(self.levels) - 1 - k][2]
                p, rest = p[parent], rest[parent]
            p, rest = p + rest * weight * one, rest * (1 - weight)
        p = p[self.leaf].reshape(self.bit.shape)
        return np.log10(np.clip(np.where(self.bit == 1, p, 1 - p), 1e-300, 1)).sum(0)


def crown(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Depths 0 and 1 from sums (ctx, node, n0, n1, log P_w of the children): what they give and what they leave.

    The first array is the probability of a 1 so far, the second the weight that deeper nodes have.
    """
    n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for ctx, node, a, b, s in rows:
        n0[ctx, node], n1[ctx, node], below[ctx, node] = a, b, s
    seen = n0 + n1 > 0
    own = log_kt(n0, n1)
    w = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    p_w = np.where(seen, np.logaddexp(own, below) - np.log(2), 0)
    a, b = n0.sum(0), n1.sum(0)
    w_root = 1 / (1 + np.exp(np.clip(p_w.sum(0) - log_kt(a, b), -700, 700)))
    w_root = np.where(a + b > 0, w_root, 0.5)
    given, left = w_root * (b + 0.5) / (a + b + 1), 1 - w_root
    out = np.where(seen, given + left * w * (n1 + 0.5) / (n0 + n1 + 1), given + left * 0.5)
    return out, np.where(seen, left * (1 - w), 0.0)


# --- Spark -------------------------------------------------------------------------------------------------


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block): block names the file split that a row is read from, in one task and always in one order.

    Inputs that don't come straight from files, or from very many small ones, are written first.
    """
    name = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block")
    rows = docs.select("doc_id", "text")
    run = rows._jdf.queryExecution()
    try:
        if "Exchange" not in run.executedPlan().toString() and len(docs.inputFiles()) <= 4 * run.toRdd().getNumPartitions():
            return docs.select("doc_id", "text", name)
    except AnalysisException:
        pass
    return materialise(rows, "texts").select("doc_id", "text", name)


def sortable(gram: np.ndarray) -> np.ndarray:
    """Grams as words that sort by the context from the nearest byte on, then by the byte: subtrees lie side by side."""
    x = gram.view(np.uint64).byteswap()
    return (x << np.uint64(8)) | (x >> np.uint64(56))


def from_sortable(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(8)) | (key << np.uint64(56))).byteswap().view(np.int64)


def pack(values: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of 64-bit words, first all lowest bytes, then all second ones; compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(block: bytes, n: int, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, n * size), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = raw.reshape(size, n).T
    return out.view("<u8").ravel()


#: Bytes of a log probability: seven bits of exponent and 33 of mantissa, exact to 6e-11 of its value.
_LP, _LOW, _BASE = 5, np.uint64(19), np.uint64(960 << 52)


def shortened(lp: np.ndarray) -> np.ndarray:
    """Log probabilities (from -300 to 0) as whole numbers of _LP bytes; one above -2^-60 becomes that."""
    return (np.maximum(-lp, 2.0**-60).view(np.uint64) - _BASE + np.uint64(1 << 18)) >> _LOW


def lengthened(short: np.ndarray) -> np.ndarray:
    return -((short << _LOW) + _BASE).view(np.float64)


def _chunked(batches, most: int):
    """(block, number of the chunk in it, its rows as batches); chunks don't depend on how rows are batched."""
    held, size, block, number, over = [], 0, None, 0, set()
    for b in batches:
        blocks = b.column("block").to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
        at = 0
        for stop in [*(np.flatnonzero(np.diff(blocks)) + 1), b.num_rows]:
            if at < stop and blocks[at] != block:
                if held:
                    yield block, number, held
                over.add(block)
                held, size, block, number = [], 0, int(blocks[at]), 0
                if block in over:
                    raise RuntimeError("rows of a file split don't come in one piece")
            while at < stop:
                until = min(stop, at + 1 + int(np.searchsorted(np.cumsum(sizes[at:stop]), most - size)))
                held.append(b.slice(at, until - at))
                size += int(sizes[at:until].sum())
                at = until
                if size >= most:
                    yield block, number, held
                    held, size, number = [], 0, number + 1
    if held:
        yield block, number, held


class _Chunk:
    """Units of a chunk (each once, and which one every unit is) and how many each row has."""

    def __init__(self, rows: list[pa.RecordBatch]):
        found = [units(texts) for b in rows for _, _, texts in chunks(b.column("text"))]
        code = pa.chunked_array([u for u, _ in found]).combine_chunks().dictionary_encode()
        self.units, self.which = code.dictionary, code.indices.to_numpy()
        self.counts = np.concatenate([c for _, c in found])

    def grams(self):
        """(first unit, index of each gram's unit, order that sorts the grams, sorted grams) for some units after others."""
        for k in range(0, len(self.units), _UNITS):
            gram, of = grams(self.units[k : k + _UNITS])
            key = sortable(gram)
            order = np.argsort(key)
            yield k, of, order, key[order]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their sums; keys come as some sorted runs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _runs(key)
    return key[first], np.add.reduceat(n[order], first)


def _dealt(key: np.ndarray, parts: int, shift: int):
    """(part, indices of its keys) of sorted keys; keys that are equal above their lowest `shift` bits share one."""
    part = (mixed(key >> np.uint64(shift)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    if len(order):
        first = _runs(part[order])
        for at, stop in zip(first, [*first[1:], len(order)]):
            yield int(part[order[at]]), order[at:stop]


def _check(key: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(key)) >> 1


#: Bits below what a key is dealt by: a gram goes with its subtree, a token by itself.
_GRAM, _TOKEN = 48, 0


def _ask(docs: DataFrame, parts: int, chunk_bytes: int = _CHUNK) -> DataFrame:
    """(part, block, chunk, size, check, keys, n): what every chunk asks of every part; tokens are asked of parts from `parts` on."""

    def work(batches):
        for block, number, rows in _chunked(batches, chunk_bytes):
            chunk = _Chunk(rows)
            train = np.concatenate([b.column("train").to_numpy(zero_copy_only=False) for b in rows]).astype(bool)
            n = np.bincount(chunk.which[np.repeat(train, chunk.counts)], minlength=len(chunk.units))
            found = []
            for k, of, order, key in chunk.grams():
                first = _runs(key)
                found.append((key[first], np.add.reduceat(n[k + of[order]], first)))
            words = tokens(chunk.units)
            word = words > 0
            asked = [(0, _GRAM, *_summed(*map(np.concatenate, zip(*found))))]
            if word.any():
                asked.append((parts, _TOKEN, *_summed(words[word], n[word])))
            del chunk, found
            for base, shift, key, count in asked:
                for part, mine in _dealt(key, parts, shift):
                    some = key[mine]
                    cols = [[base + part], [block], [number], [len(some)], [_check(some)], [pack(some, 8)], [pack(count[mine], 4)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 5 + [pa.binary()] * 2)], ["part", "block", "chunk", "size", "check", "keys", "n"])
        give_back()

    train = ~in_bucket(F.col("doc_id"), *CLASSES)
    return docs.select("text", "block", train.alias("train")).mapInArrow(work, "part long, block long, chunk long, size long, check long, keys binary, n binary")


def _written(rows: DataFrame, by: list[str], name: str) -> str:
    """Write rows as one folder for each value of `by`, the rows of which meet in one task; leaves no shuffle files."""
    conf, path = rows.sparkSession.conf, new_path(rows.sparkSession, name)
    n, before = int(conf.get("spark.sql.shuffle.partitions")), conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        rows.repartition(n, *by).write.partitionBy(*by).parquet(path)
    finally:
        conf.set(_CLEAN, before)
    return path


def _load(path: str) -> pa.Table | None:
    fs, local = open_fs(path)
    if fs.get_file_info(local).type == pafs.FileType.NotFound:
        return None
    return pads.dataset(local, filesystem=fs, format="parquet").to_table()


class _Asked:
    """What is asked of a part: each key once with its count, and which of them every question holds."""

    def __init__(self, t: pa.Table):
        self.t, self.sizes = t, t["size"].to_numpy()
        key = np.concatenate([unpack(x.as_py(), n, 8) for x, n in zip(t["keys"], self.sizes)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = _runs(key)
        count = np.concatenate([unpack(x.as_py(), n, 4) for x, n in zip(t["n"], self.sizes)]).astype(np.int64)
        self.key, self.n = key[first], np.add.reduceat(count[order], first)
        self.at = np.empty(len(key), np.int32)
        self.at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))

    def answers(self, values: np.ndarray, size: int):
        """A row for each question: the values of its keys."""
        stop = np.cumsum(self.sizes)
        for i, (a, b) in enumerate(zip(stop - self.sizes, stop)):
            block = pa.array([pack(values[self.at[a:b]], size)], pa.binary())
            row = self.t.slice(i, 1).select(["block", "chunk", "size", "check"]).combine_chunks().to_batches()[0]
            yield [*row.columns, block]


def _subtrees(key: np.ndarray, n: np.ndarray):
    """(start, stop, Subtrees) over sorted keys, whole subtrees at a time; a large one comes in eight, decision by decision."""
    first = _runs(key >> np.uint64(_GRAM)) if len(key) else []
    start = 0
    for at, stop in zip(first, [*first[1:], len(key)]):
        if stop - start > _SUBTREE and at > start:
            yield start, at, Subtrees(from_sortable(key[start:at]), n[start:at])
            start = at
        if stop - start > 4 * _SUBTREE:
            for j in range(8):
                yield start, stop, Subtrees(from_sortable(key[start:stop]), n[start:stop], slice(j, j + 1))
            start = stop
    if start < len(key):
        yield start, len(key), Subtrees(from_sortable(key[start:]), n[start:])


def _answers(spark, asked: str, parts: int) -> tuple[str, int, int]:
    """(folder of the answers by block and chunk, number of words in training rows, number of different ones)."""
    every = spark.range(0, 2 * parts, 1, 2 * parts)

    def upper(batches):
        for b in batches:
            for part in b.column("id").to_pylist():
                t = _load(f"{asked}/part={part}")
                if t is None:
                    continue
                mine = _Asked(t)
                seen = mine.n > 0
                key, n = mine.key[seen], mine.n[seen]
                if part >= parts:
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), *(pa.array([float(x)]) for x in (n.sum(), len(n), 0))], ["ctx", "node", "n0", "n1", "s"])
                else:
                    for _, _, trees in _subtrees(key, n):
                        yield pa.RecordBatch.from_arrays([*map(pa.array, trees.sums())], ["ctx", "node", "n0", "n1", "s"])
        give_back()

    high = every.mapInArrow(upper, "ctx long, node long, n0 double, n1 double, s double")
    # At most 256 * 255 rows and one, whatever the corpus.
    high = [tuple(r) for r in high.groupBy("ctx", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("s")).collect()]
    words, different = next((r[2:4] for r in high if r[0] < 0), (0, 0))
    sent = spark.sparkContext.broadcast(crown([r for r in high if r[0] >= 0]))

    def answer(batches):
        for b in batches:
            for part in b.column("id").to_pylist():
                t = _load(f"{asked}/part={part}")
                if t is None:
                    continue
                mine = _Asked(t)
                if part >= parts:
                    values, size = mine.n, 8
                else:
                    lp = np.zeros(len(mine.key))
                    for start, stop, trees in _subtrees(mine.key, mine.n):
                        lp[start:stop] += trees.log_probability(sent.value)
                    values, size = shortened(lp), _LP
                for cols in mine.answers(values, size):
                    yield pa.RecordBatch.from_arrays([pa.array([part]), *cols], ["part", "block", "chunk", "size", "check", "found"])
        give_back()

    told = every.mapInArrow(answer, "part long, block long, chunk long, size long, check long, found binary")
    return _written(told, ["block", "chunk"], "answers"), int(words), int(different)


def _found(answers: dict, key: np.ndarray, base: int, parts: int, shift: int, size: int) -> np.ndarray:
    """The values of sorted keys, from the answers of all parts."""
    out = np.zeros(len(key), np.uint64)
    for part, mine in _dealt(key, parts, shift):
        n, check, found = answers.get(base + part, (0, 0, b""))
        if (n, check) != (len(mine), _check(key[mine])):
            raise RuntimeError("a file split gave other rows when it was read again")
        out[mine] = unpack(found, n, size)
    return out


def score(docs: DataFrame, chunk_bytes: int = _CHUNK) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    chunk_bytes: bytes of text that a task takes at a time; it changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = located(docs)
    ends = rows.where(~in_bucket(F.col("doc_id"), *CLASSES)).count()
    asked = _written(_ask(rows, parts, chunk_bytes), ["part"], "asked")
    path, n, v = _answers(spark, asked, parts)
    remove(spark, asked)
    small_batches(spark)
    n, v = n + ends, v + (ends > 0)

    def work(batches):
        for block, number, held in _chunked(batches, chunk_bytes):
            t = _load(f"{path}/block={block}/chunk={number}")
            if t is None:
                raise RuntimeError("a file split gave other rows when it was read again")
            answers = {p: tuple(rest) for p, *rest in zip(*(t[x].to_pylist() for x in ("part", "size", "check", "found")))}
            chunk = _Chunk(held)
            # Sorted grams of some units at a time: those that differ, and which of them each gram is.
            some = []
            for k, of, order, key in chunk.grams():
                first = _runs(key)
                at = np.empty(len(key), np.int32)
                at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
                some.append((k, of.astype(np.int32), key[first], at))
            keys = np.sort(np.concatenate([x[2] for x in some]), kind="stable")
            keys = keys[_runs(keys)]
            found = lengthened(_found(answers, keys, 0, parts, _GRAM, _LP))
            lp = np.zeros(len(chunk.units))
            for k, of, key, at in some:
                of_units = np.bincount(of, found[np.searchsorted(keys, key)][at])
                lp[k : k + len(of_units)] = of_units
            del some, keys, found
            words = tokens(chunk.units)
            keys, at = np.unique(words, return_inverse=True)
            real = keys > 0
            c = np.full(len(keys), ends, np.int64)  # of the end, which every text has once
            c[real] = _found(answers, keys[real], parts, parts, _TOKEN, 8).astype(np.int64)
            c = c[at]
            base = np.log10((c + 1.0) / (n + v + 1.0))
            first = np.cumsum(chunk.counts) - chunk.counts
            cols = [chunk.counts, np.add.reduceat((c > 0).astype(np.int64)[chunk.which], first), np.add.reduceat(base[chunk.which], first), np.add.reduceat(lp[chunk.which], first)]
            del chunk
            ids = pa.chunked_array([b.column("doc_id") for b in held])
            for k in range(0, len(ids), 100_000):
                some = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([ids[some].combine_chunks(), *(pa.array(x[some]) for x in cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", in_bucket(F.col("doc_id"), *CLASSES).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
