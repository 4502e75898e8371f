"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import fresh_path

#: A graph of so few edges is one task's work.
SMALL = 20_000
_EDGE = "u long, v long"


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _stars(large: bool):
    """A star step over rows sorted by (u, v), u's neighbours in turn; repeats fall away.

    The smallest of u and its neighbours becomes the centre: of u's larger neighbours in
    the large step; in the small step, where all neighbours are smaller, of u and the rest.
    """

    def run(batches):
        held = None  # u and its centre, and the last v, of the batch before
        for b in batches:
            u, v = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(u):
                continue
            new = np.concatenate([[held is None or held[0] != u[0]], u[1:] != u[:-1]])
            at = np.flatnonzero(new)
            first = np.append(v[at], held[1] if held else 0)[np.cumsum(new) - 1]
            centre = np.minimum(first, u)
            again = ~new & (v == np.concatenate([[held[2] if held else 0], v[:-1]]))
            held = (u[-1], centre[-1], v[-1])
            if large:
                take = (v > u) & ~again
                yield _batch(v[take], centre[take])
            else:
                take = (v != centre) & ~again
                yield _batch(np.concatenate([u[new], v[take]]), np.concatenate([centre[new], centre[take]]))

    return run


def _forest(batches):
    """All edges of a small graph in one task: each node and its component's smallest."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(p) for p in zip(*parts))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:  # each round hands the smaller label along every edge, then shortens paths
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    yield _batch(nodes[other], nodes[label[other]])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of undirected edges (u, v); label is the smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to
    its smallest neighbour, then its smaller ones. Each step is one exchange, sorted and
    streamed, so no node's neighbours are held. Edges never grow in number, rounds grow
    with the logarithm of the components' size, and each round is written to the shared
    folder, so a lost executor costs one round at most. It ends when number and full 64-bit
    hash sum of the edges stay as they were. A graph of at most ``SMALL`` edges
    is done in one task instead. Edges with a null end are left out.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen, path = Observation(), fresh_path(spark, "edges")
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).write.parquet(path)
        return spark.read.schema(_EDGE).parquet(path), (seen.get["n"], seen.get["s"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "u").sortWithinPartitions("u", "v")

    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, size = write(now)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if 0 < size[0] <= SMALL:
        now, _ = write(now.coalesce(1).mapInArrow(_forest, _EDGE))
        size = None
    while size and size[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = dealt(both).mapInArrow(_stars(True), _EDGE)
        now, new = write(dealt(larger).mapInArrow(_stars(False), _EDGE))
        if new == size:
            break
        size = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(now.select("v", "v").distinct()).distinct()
