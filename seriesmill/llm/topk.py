"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are turned into integers first (floor(scale * x), so scores are exact). Candidates are sorted by descending
length and packed into blocks of BLOCK_ROWS in that order; a block knows its greatest length. The d x d sum of outer
products of all candidates gives the rotation that gathers most of the mass in the first coordinates; a score is then
at most the partial sum over those plus the product of the lengths of what is left. Queries are packed in the same way.

Round one scores every query against the block of longest vectors, which gives each query the k-th best score that it
surely reaches: its floor. A query block then needs the candidate blocks whose greatest length, times its own, reaches
the floor of one of its queries; this is decided on a table of blocks without vectors, and only pairs that pass are
shipped. They are dealt out in runs of up to RUN blocks of descending length, along which the floors rise: a block, a
query or a pair whose bound lies below is not computed; survivors are scored exactly in integers.

Blocks, pairs and floors live in tables. What reaches the driver is one d x d matrix per dimension and two counts, and
no plan grows with the number of rows.

Defined results: null vectors and vectors with a null or non-finite component take no part; only vectors of equal
dimension are compared; rows equal in id and vector are one row; several rows of one id are rows of their own, and
only the row itself is left out of its own candidates; components are held to +-2**25, which keeps scores of up to 4096
dimensions within 64 bits; ties go to the smaller id; a query with no candidates gives no row; an empty table gives
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_batches

K = 5
SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 256
#: Candidate blocks that one task takes one after another for a query block, about.
RUN = 32
#: Tasks that add up the matrices of all others.
MERGERS = 16
#: Share of the mass that the first coordinates of the rotation hold.
MASS = 0.6
LIMIT = 1 << 25


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<int>, dim, norm2) of the vectors that take part, each once."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    out = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).groupBy("id", "v").agg(F.lit(1).alias("_"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    return out.select("id", "v", F.size("v").alias("dim"), norm.alias("norm2"))


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows by descending length as blocks (block, dim, n, top, ids, data): int64 and int32 buffers, top the greatest length."""

    def pack(batches):
        held, n = None, 0  # rows of one dimension that wait for their block to fill
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            dims = t["dim"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            held = None
            for s, e in zip(edges[:-1], edges[1:]):
                for k in range(s, e, most):
                    if e == len(dims) and e - k < most:
                        held = t.slice(k, e - k)
                    else:
                        yield one(t.slice(k, min(most, e - k)))
        if held is not None and held.num_rows:
            yield one(held)

    def one(t):
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4")
        return pa.RecordBatch.from_arrays([t["dim"][:1].combine_chunks(), pa.array([t.num_rows], pa.int32()), pa.array([float(np.sqrt(max(t["norm2"].to_pylist())))]), pa.array([t["id"].to_numpy().astype("<i8").tobytes()]), pa.array([flat.tobytes()])], ["dim", "n", "top", "ids", "data"])

    ordered = rows.select("dim", "id", "v", "norm2").orderBy("dim", F.desc("norm2"), "id")
    packed = ordered.mapInArrow(pack, "dim int, n int, top double, ids binary, data binary")
    return materialise(packed.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def rotations(rows: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension: the rotation and how many of its coordinates hold MASS of all squared length.

    Tasks add up d x d sums.
    """

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d)).column("v").flatten().to_numpy(zero_copy_only=False)
                x = part.astype(float).reshape(-1, d) if d else np.zeros((0, 0))
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["dim", "g"])

    total: dict[int, np.ndarray] = {}
    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                sums[r["dim"]] = sums.get(r["dim"], 0) + np.frombuffer(r["g"]).reshape(r["dim"], r["dim"])
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["dim", "g"])

    # Tasks' sums are merged by a few tasks first, so the driver sees MERGERS matrices a dimension at most.
    sums = rows.select("dim", "v").mapInArrow(add, "dim int, g binary").withColumn("p", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    for r in sums.repartition(MERGERS, "p").select("dim", "g").mapInArrow(merge, "dim int, g binary").collect():
        total[r.dim] = total.get(r.dim, 0) + np.frombuffer(r.g).reshape(r.dim, r.dim)
    out = {}
    for d, g in total.items():
        values, vectors = np.linalg.eigh(g) if d else (np.zeros(0), np.zeros((0, 0)))
        values, vectors = values[::-1], vectors[:, ::-1]
        held = np.cumsum(values) / max(values.sum(), 1e-300)
        out[d] = np.ascontiguousarray(vectors), int(min(d, np.searchsorted(held, MASS) + 1)) if d else 0
    return out


def best_in_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, floor: np.ndarray | None, k: int, turn: tuple[np.ndarray, int]) -> list[tuple[int, int, int]]:
    """(query row, candidate row, score) of up to k best candidates of every query; exact for scores of at least floor."""
    if not len(q) or not len(x):
        return []
    vectors, head = turn
    norms = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.lexsort((x_ids, -norms))
    x, x_ids, norms = x[order], x_ids[order], norms[order]
    out = []
    q_norms = np.sqrt((q.astype(float) ** 2).sum(1))
    rows = np.arange(len(q))
    if floor is not None:
        rows = rows[q_norms * norms[0] >= floor[rows] - 1]  # the longest candidate can't reach: skip the query
        if not len(rows):
            return []
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) >= 2**52
    exact = np.int64 if big else np.float64
    if floor is None:
        keep = np.ones((len(rows), len(x)), bool)
        scores = q[rows].astype(exact) @ x.astype(exact).T
    else:
        qr, xr = q[rows].astype(float) @ vectors, x.astype(float) @ vectors
        rest_q, rest_x = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((xr[:, head:] ** 2).sum(1))
        bound = qr[:, :head] @ xr[:, :head].T + np.outer(rest_q, rest_x)
        keep = bound >= (floor[rows] - 1 - 1e-9 * q_norms[rows] * norms[0])[:, None]
        cols = np.flatnonzero(keep.any(0))
        live = np.flatnonzero(keep.any(1))
        if not len(cols):
            return []
        rows, keep = rows[live], keep[np.ix_(live, cols)]
        x, x_ids = x[cols], x_ids[cols]
        scores = q[rows].astype(exact) @ x.astype(exact).T
    for n, r in enumerate(rows):
        allowed = keep[n] & ~((x_ids == q_ids[r]) & (x == q[r]).all(1)) if (x_ids == q_ids[r]).any() else keep[n]
        c = np.flatnonzero(allowed)
        s = scores[n, c].astype(np.int64)
        if len(c) > k:
            kth = np.partition(s, len(s) - k)[len(s) - k]
            some = s >= kth
            c, s = c[some], s[some]
        best = np.lexsort((x_ids[c], -s))[:k]
        out += [(int(r), int(x_ids[c[b]]), int(s[b])) for b in best]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best candidates of every row that `queries` (a condition on column id) holds for."""
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, id_col, vector_col, scale), "vectors")
    sent = spark.sparkContext.broadcast(rotations(rows))  # d x d floats per dimension
    small_batches(spark)
    blocks = _packed(rows, block_rows, "blocks")
    asked = _packed(rows.where(queries), query_rows, "queries").withColumnsRenamed({"block": "qb", "n": "q_n", "top": "q_top", "ids": "q_ids", "data": "q_data"})
    meta = materialise(blocks.select("block", "dim", "top"), "block-table")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "qb long, row int, query_id long, vec long, score long"

    def score(batches):
        """Rows by (qb, run, descending top): floors rise from block to block of one (qb, run)."""
        at, floor, best = None, None, None
        for b in batches:
            for r in b.to_pylist():
                q, x = np.frombuffer(r["q_data"], "<i4").reshape(r["q_n"], r["dim"]), np.frombuffer(r["data"], "<i4").reshape(r["n"], r["dim"])
                q_ids, x_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                if at != (r["qb"], r["run"]):
                    at, best = (r["qb"], r["run"]), [[] for _ in q_ids]
                    floor = np.frombuffer(r["floors"], "<f8").copy() if r["floors"] is not None else None
                found = best_in_block(q, q_ids, x, x_ids, floor, k, sent.value[r["dim"]])
                for row, _, s in found if floor is not None else ():
                    best[row] = sorted([*best[row], s], reverse=True)[:k]
                    if len(best[row]) == k:
                        floor[row] = max(floor[row], best[row][-1])
                rows_, vec, s = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([r["qb"]] * len(found), pa.int64()), pa.array(rows_, pa.int32()), pa.array(q_ids[list(rows_)], pa.int64()), pa.array(vec, pa.int64()), pa.array(s, pa.int64())], ["qb", "row", "query_id", "vec", "score"])

    # Round one: the block of longest vectors of each dimension.
    longest = meta.groupBy("dim").agg(F.min_by("block", F.struct(-F.col("top"), "block")).alias("block"))
    heads = asked.join(longest, "dim").join(blocks.drop("dim"), "block").withColumns({"run": F.lit(0), "floors": F.lit(None).cast("binary")})
    first = materialise(heads.repartition(parts, "qb").mapInArrow(score, shape), "first")

    def needed(batches):
        """Floors of all queries of a block, and the least length that a candidate of one of them must have."""
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q_data"], "<i4").reshape(r["q_n"], r["dim"]).astype(float)
                length, floor = np.sqrt((q**2).sum(1)), np.full(r["q_n"], -np.inf)
                for row, s in dict(r["known"] or ()).items():
                    floor[row] = s
                least = np.divide(floor - 1, length, out=np.full(len(floor), -np.inf), where=length > 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["qb"]], pa.int64()), pa.array([r["dim"]], pa.int32()), pa.array([floor.astype("<f8").tobytes()]), pa.array([float(least.min())])], ["qb", "dim", "floors", "least"])

    kth = first.groupBy("qb", "row").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k)
    kth = kth.groupBy(F.col("qb").alias("f_qb")).agg(F.map_from_entries(F.collect_list(F.struct("row", F.element_at("s", k)))).alias("known"))
    floors = asked.join(kth, F.col("qb") == F.col("f_qb"), "left").select("qb", "dim", "q_n", "q_data", "known")
    floors = materialise(floors.mapInArrow(needed, "qb long, dim int, floors binary, least double"), "floors")

    # Pairs of blocks by numbers alone. Candidate blocks are dealt into runs, so that no dimension is one hot key.
    runs = max(1, -(-meta.count() // RUN))
    rest = meta.join(longest.select(F.col("block").alias("_l")), F.col("block") == F.col("_l"), "left_anti").withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int"))
    wanted = floors.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    pairs = rest.join(wanted, ["dim", "run"]).where(F.col("top") * (1 + 1e-9) >= F.col("least")).select("block", "top", "qb", "run", "floors")
    work = pairs.join(blocks.select("block", "dim", "n", "ids", "data"), "block").join(asked.drop("dim", "q_top"), "qb")
    work = work.repartition(parts, "qb", "run").sortWithinPartitions("qb", "run", F.desc("top"), "block")
    ranked = W.partitionBy("qb", "row").orderBy(F.desc("score"), "vec")
    best = first.unionByName(work.mapInArrow(score, shape)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")
