"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to many pivots are computed once. For a query q and a candidate x
the triangle inequality gives |d(q,p) - d(x,p)| <= d(q,x) for each pivot p; the greatest of
these lower bounds caps the score, since 2<q,x> = |q|^2 + |x|^2 - d(q,x)^2. Candidates are
evaluated exactly in the order of that cap until the cap falls below the k-th best score,
or below the k-th best of the query's scores with the pivots, with which every block begins.

Blocks of queries are written once to files in the shared folder. A task holds as many
candidates as ``HOLD`` allows, in blocks, and streams the queries' files past them; it carries
each query's threshold from block to block and keeps only its best of all of them. No row of
queries is copied for a block of candidates, so no exchange grows with their product.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, small_batches
from .storage import open_input, publish

#: Bytes of 64-bit components that a task holds at a time.
HOLD = 32 << 20
_QUERIES = pa.schema([(c, pa.binary()) for c in ("ids", "vectors", "table", "floors")] + [("dim", pa.int64())])
_LONG = (1 << 63) - 1


def quantise(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as double; exact whole numbers of 64 bits."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and not np.abs(scaled).max() < 2.0**63:
        raise OverflowError("a scaled component doesn't fit in 64 bits")
    return scaled.astype(np.int64)


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x with q."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))
    if most * max(len(q), 1) <= _LONG:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    if len(exact) and max(map(abs, exact)) > _LONG:
        raise OverflowError("a score doesn't fit in 64 bits")
    return exact.astype(np.int64)


def _rows(batch):
    """(ids, matrix) per vector length of a batch; unusable vectors left out."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1).cast(pa.list_(pa.float64()))
    offsets = np.asarray(lists.offsets)
    sizes, starts = np.diff(offsets), offsets[:-1]
    values = np.asarray(lists.values.fill_null(np.nan))
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        m = values[starts[at][:, None] + np.arange(dim)]
        fine = np.isfinite(m).all(1)
        if fine.any():
            yield ids[at[fine]], m[fine]


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row to each pivot, from their differences: no digits cancel."""
    m, pivots = m.astype(np.float64), pivots.astype(np.float64)
    return np.stack([np.sqrt(((m - p) ** 2).sum(1)) for p in pivots], 1).astype(np.float32)


def _holds(batches, scale: float):
    """{length: (ids, scaled vectors)} of rows in turn, each of about ``HOLD`` bytes in all."""
    held: dict[int, list] = {}
    size = 0
    together = lambda: {dim: tuple(np.concatenate(c) for c in zip(*own)) for dim, own in held.items()}
    for batch in batches:
        for ids, vectors in _rows(batch):
            m = quantise(vectors, scale)
            held.setdefault(m.shape[1], []).append((ids.astype(np.int64), m))
            size += m.nbytes
        if size >= HOLD:
            yield together()
            held.clear()
            size = 0
    if held:
        yield together()


def search_block(q_ids, q, q_table, x_ids, x, x_table, k: int, floors=None):
    """Each query's k best distinct ids of one block of candidates: (query, candidate, score) arrays.

    ``floors`` has a score that each query's k-th best is known to reach. Returns also how
    many candidates each query evaluated exactly.
    """
    q2, x2 = (q.astype(np.float64) ** 2).sum(1), (x.astype(np.float64) ** 2).sum(1)
    bound = np.zeros((len(q), len(x)), np.float32)
    for p in range(q_table.shape[1]):
        np.maximum(bound, np.abs(q_table[:, p, None] - x_table[None, :, p]), out=bound)
    # tables are rounded to single precision, norms to double: give way by the rounding errors
    slack = 4e-7 * (float(q_table.max(initial=0)) + float(x_table.max(initial=0))) + 1e-6
    norms = q2[:, None] + x2[None, :]
    cap = (norms * (1 + 1e-12) - np.maximum(bound.astype(np.float64) - slack, 0) ** 2) / 2 + 0.5
    found, work = ([], [], []), np.zeros(len(q), np.int64)
    for i in range(len(q)):
        row = cap[i].copy()
        row[x_ids == q_ids[i]] = -np.inf
        least = -np.inf if floors is None else floors[i]
        alive = int(np.count_nonzero((row > -np.inf) & (row >= least)))
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, done, step = np.zeros(0, int), 0, 4 * k
        while done < alive:
            if done == len(order):  # the next stretch of the order of caps
                size = min(alive, max(64, 4 * len(order)))
                order = np.argpartition(-row, size - 1)[:size] if size < len(row) else np.arange(len(row))
                order = order[np.lexsort((order, -row[order]))][:alive]
            if len(best_s) == k and row[order[done]] < best_s[-1]:
                break
            at = order[done : done + step]
            done, work[i] = done + len(at), work[i] + len(at)
            step = min(2 * step, 4096)
            s, ids = np.concatenate([best_s, dot(x[at], q[i])]), np.concatenate([best_i, x_ids[at]])
            top = np.lexsort((ids, -s))
            top = top[np.sort(np.unique(ids[top], return_index=True)[1])[:k]]  # an id's best row only
            best_s, best_i = s[top], ids[top]
        found[0].append(np.full(len(best_s), q_ids[i]))
        found[1].append(best_i)
        found[2].append(best_s)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found), work


def floors_of(q_ids: np.ndarray, q: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query with pivots of other ids, an id counted once."""
    out = np.full(len(q), -np.inf)
    for i in range(len(q)):
        s = dot(pivots, q[i])
        best = {}
        for j, v in zip(pivot_ids.tolist(), s.tolist()):
            if j != q_ids[i]:
                best[j] = max(best.get(j, v), v)
        if len(best) >= k:
            out[i] = sorted(best.values())[-k]
    return out


def best_of(query: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best distinct ids, an id with its best score: (query, id, score, rank from 0), in order."""
    order = np.lexsort((ids, -s, query))
    query, ids, s = query[order], ids[order], s[order]
    by = np.lexsort((ids, query))  # stable: an id's best score stays first
    first = np.ones(len(ids), bool)
    first[by[1:]] = (query[by[1:]] != query[by[:-1]]) | (ids[by[1:]] != ids[by[:-1]])
    query, ids, s = query[first], ids[first], s[first]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(c[rank < k] for c in (query, ids, s, rank))


def far_apart(ids: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n rows, each the farthest from those taken before it."""
    picked = [0]
    near = ((m.astype(np.float64) - m[0]) ** 2).sum(1)
    while len(picked) < min(n, len(m)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((m.astype(np.float64) - m[picked[-1]]) ** 2).sum(1))
    return ids[picked], m[picked]


def top_k(vectors: DataFrame, k: int = 5, query_modulus: int = 50, scale: float = 256.0, pivots: int = 48, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", with_work: bool = False) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates all rows
    with another id. Ties go to the smaller id; rows repeated under one id count once, with
    the best of their scores; fewer candidates give fewer rows, an empty table none. Null
    vectors or ids, empty vectors, and vectors with null or non-finite components take no
    part; vectors of different length are not compared; other columns are ignored. Numbers
    are exact whatever their size; a scaled component or a score that doesn't fit in 64 bits
    raises OverflowError. The pivots are ``pivots`` vectors of each length far apart from
    one another, picked among eight times as many that come first by a hash of their ids.
    ``with_work`` adds ``evaluated``, how many candidates the query evaluated exactly.
    """
    small_batches(vectors)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).where("id is not null and v is not null and size(v) > 0")
    few = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # the smallest hashes of each length: first within a task's share, then over the shares
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    share = few.select("id", "v", F.size("v").alias("dim"), F.xxhash64("id").alias("h"), F.spark_partition_id().alias("s")).withColumn("r", rank("dim", "s")).where(F.col("r") <= 8 * pivots)
    picked = share.withColumn("r", rank("dim")).where(F.col("r") <= 8 * pivots).select("dim", "id", "v").collect()
    table: dict[int, tuple[np.ndarray, ...]] = {}  # ids and vectors of the pivots, then of all picked
    for dim in {r.dim for r in picked}:
        own = sorted((r for r in picked if r.dim == dim), key=lambda r: r.id)
        ids, m = np.array([r.id for r in own], np.int64), quantise(np.array([r.v for r in own]), scale)
        table[dim] = (*far_apart(ids, m, pivots), ids, m)

    once = materialise(few.dropDuplicates(["id", "v"]), "vectors")
    asking = once.where(F.col("id") % query_modulus == 0)
    some, folder = max(1, block // 4), fresh_path(once.sparkSession, "queries")

    def store(batches):
        """Writes blocks of queries, with their distances and the scores that they reach, to one file."""
        file = None
        for held in _holds(batches, scale):
            for dim, (ids, m) in held.items():
                for at in range(0, len(ids), some):
                    if file is None:
                        file = publish(folder, f"part-{uuid.uuid4().hex}.arrow")
                        out = file.open()
                        writer = pa.ipc.new_stream(out, _QUERIES)
                    q_ids, q = ids[at : at + some], m[at : at + some]
                    row = (q_ids, q, distances(q, table[dim][1]), floors_of(q_ids, q, *table[dim][2:], k))
                    writer.write_batch(pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in row], pa.array([dim], pa.int64())], schema=_QUERIES))
        if file:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": file.done()}])

    paths = [r.path for r in asking.repartition(max(1, -(-asking.count() // (8 * some)))).mapInArrow(store, "path string").collect()]

    def search(batches):
        for held in _holds(batches, scale):
            blocks = {dim: [(ids[at : at + block], m[at : at + block], distances(m[at : at + block], table[dim][1])) for at in range(0, len(ids), block)] for dim, (ids, m) in held.items()}
            for path in paths:
                with open_input(path) as f, pa.ipc.open_stream(f) as stream:
                    for b in stream:
                        dim = b.column(4)[0].as_py()
                        if dim not in blocks:
                            continue
                        q_ids, qs, qt, floors = (np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.float32, np.float64)))
                        qs, qt, floors = qs.reshape(-1, dim), qt.reshape(len(q_ids), -1), floors.copy()
                        best, work = [np.zeros(0, np.int64)] * 3, np.zeros(len(q_ids), np.int64)
                        for x_ids, x, xt in blocks[dim]:
                            found, did = search_block(q_ids, qs, qt, x_ids, x, xt, k, floors)
                            *best, rank = best_of(*[np.concatenate(c) for c in zip(best, found)], k)
                            work += did
                            full, kth = best[0][rank == k - 1], best[2][rank == k - 1]
                            if len(full):
                                at = np.minimum(np.searchsorted(full, q_ids), len(full) - 1)
                                floors = np.where(full[at] == q_ids, np.maximum(floors, kth[at]), floors)
                        done = np.flatnonzero(work) if with_work else work[:0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.append(best[0], q_ids[done])), pa.array(best[1].tolist() + [None] * len(done), pa.int64()), pa.array(best[2].tolist() + work[done].tolist(), pa.int64())], names=["query_id", "vec_id", "score"])

    got = once.mapInArrow(search, "query_id long, vec_id long, score long")
    if with_work:
        got = materialise(got, "found")
    found = got.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return best.join(got.where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("evaluated")), "query_id", "left") if with_work else best
