"""Percentiles with a guaranteed rank error, from mergeable digests of dyadic-tree counts.

Values are quantized to the universe 0 .. 2**LEVELS - 1. A digest counts nodes of the binary tree over it: node
``2**LEVELS + q`` is the leaf of ``q``, ``node >> 1`` a node's parent, and a node stands for all leaves below it. To
compress with parameter ``k``, a pair of siblings moves up to its parent if the three hold less than ``n / k`` rows.

Guarantee: a value's rank is off by at most the counts of its leaf's ancestors, each below ``n / k``, so by at most
``LEVELS / k`` of the rows. Digests are merged by adding the counts of equal nodes, which adds both ``n`` and the error
bounds, so the relative error stays. ``k = LEVELS / error``.

Scale: each partition makes the digests of its own rows in its task (at most about ``3 k`` nodes a group, however many
rows), only nodes are shuffled, and a group's nodes, not its rows, are ordered to read percentiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 20
ERROR = 0.005
EXACT_BITS = 15
UNIT = 1_000_000
FLUSH_ROWS = 4_000_000


def quantize_count(c: Column) -> Column:
    """Leaf of a count from 0 to 2**31 - 1: exact below 2**15, above that to the first 15 binary digits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(c)) - EXACT_BITS)
    return F.when(c < (1 << EXACT_BITS), c.cast("int")).otherwise(
        (shift * (1 << (EXACT_BITS - 1)) + F.floor(c / F.pow(F.lit(2), shift))).cast("int")
    )


def count_of(q: Column) -> Column:
    """The least count of a leaf."""
    half = 1 << (EXACT_BITS - 1)
    shift = F.greatest(F.lit(0), F.floor(q / half) - 1)
    return ((q - shift * half) * F.pow(F.lit(2), shift)).cast("double")


def quantize_unit(c: Column) -> Column:
    """Leaf of a value from 0 to 1, in steps of a millionth."""
    return F.round(c * UNIT).cast("int")


def unit_of(q: Column) -> Column:
    return (F.least(q, F.lit(UNIT)) / UNIT).cast("double")


def compress_nodes(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest of each group, compressed; rows need no order and may repeat a node."""
    group, node, count = _sum_equal(group, node, count)
    sizes = np.zeros(int(group.max()) + 1 if len(group) else 1, dtype=np.int64)
    np.add.at(sizes, group, count)
    most = sizes // k
    if not len(group) or most.max() < 1:
        return group, node, count
    for level in range(LEVELS, 0, -1):
        here = (node >> level) == 1
        if not here.any():
            continue
        g, up, c = group[here], node[here] >> 1, count[here]
        at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (up[1:] != up[:-1])])
        pg, pn, pc = g[at], up[at], np.add.reduceat(c, at)
        # what the parent has itself
        order = np.flatnonzero((node >> (level - 1)) == 1)
        key, want = group[order] << (LEVELS + 2) | node[order], pg << (LEVELS + 2) | pn
        own = np.zeros(len(want), dtype=np.int64)
        if len(key):
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            own = np.where(key[i] == want, count[order][i], 0)
        moves = pc + own < most[pg]
        if moves.any():
            child_moves = np.repeat(moves, np.diff(np.r_[at, len(g)]))
            gone = np.flatnonzero(here)[child_moves]
            keep = np.ones(len(node), dtype=bool)
            keep[gone] = False
            group, node, count = _sum_equal(
                np.r_[group[keep], pg[moves]], np.r_[node[keep], pn[moves]], np.r_[count[keep], pc[moves]]
            )
    return group, node, count


def _sum_equal(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = group.astype(np.int64) << (LEVELS + 2) | node
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return key[:0], key[:0], count[:0]
    return key[at] >> (LEVELS + 2), key[at] & ((1 << (LEVELS + 2)) - 1), np.add.reduceat(count, at)


def partial_digests(values: DataFrame, keys: Sequence[str], leaf: str, error: float = ERROR) -> DataFrame:
    """Keys, ``node`` and ``cnt``: one digest per partition and group, compressed in the task. Rows with a null leaf
    are left out; the keys are strings, null ones left out too."""
    k = math.ceil(LEVELS / error)
    schema = pa.schema([*[(c, pa.string()) for c in keys], ("node", pa.int64()), ("cnt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held: list[tuple] = []
        rows = 0

        def fold() -> tuple:
            return compress_nodes(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)

        for b in batches:
            frame = b.to_pandas()
            code, first = pd.MultiIndex.from_frame(frame[list(keys)]).factorize()
            to = np.array([names.setdefault(tuple(x), len(names)) for x in first], dtype=np.int64)
            held.append((to[code], frame[leaf].to_numpy(np.int64) + (1 << LEVELS), np.ones(len(frame), dtype=np.int64)))
            rows += len(frame)
            if rows > FLUSH_ROWS:
                held = [fold()]
                rows = len(held[0][0])
        if held:
            g, n, c = fold()
            own = list(names)
            for i in range(0, len(g), 100_000):
                s = slice(i, i + 100_000)
                cols = [pa.array([own[x][j] for x in g[s]], pa.string()) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n[s]), pa.array(c[s])], schema=schema)

    known = values.select(*keys, F.col(leaf).cast("int").alias(leaf))
    for c in (*keys, leaf):
        known = known.filter(F.col(c).isNotNull())
    out = ", ".join([*[f"`{c}` string" for c in keys], "node long", "cnt long"])
    return known.mapInArrow(run, out)


def merge_digests(digests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digests of several row sets as one per group: the counts of equal nodes are added."""
    return digests.groupBy(*keys, "node").agg(F.sum("cnt").alias("cnt"))


def recompress(digests: DataFrame, keys: Sequence[str], error: float = ERROR) -> DataFrame:
    """Merged digests brought back to about ``3 k`` nodes a group, to be stored and merged again later."""
    k = math.ceil(LEVELS / error)
    columns = [*keys, "node", "cnt"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        zero = np.zeros(len(frame), dtype=np.int64)
        _, node, cnt = compress_nodes(zero, frame["node"].to_numpy(np.int64), frame["cnt"].to_numpy(np.int64), k)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * len(node) for c in keys}, "node": node, "cnt": cnt})

    return digests.select(*columns).groupBy(*keys).applyInPandas(run, digests.select(*columns).schema)


def digest_percentiles(digests: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Keys, ``point``, ``leaf`` and ``n``, the group's rows. Nodes are read in the order of their greatest leaf, small
    nodes first; the percentile is the greatest leaf of the node that reaches the rank."""
    level = F.length(F.bin("node")) - 1
    rest = F.lit(LEVELS) - level
    top = ((F.col("node") + 1) * F.pow(F.lit(2), rest)).cast("long") - 1 - (1 << LEVELS)
    order = Window.partitionBy(*keys).orderBy("_top", "_rest").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        digests.withColumns({"_top": top, "_rest": rest})
        .withColumn("_to", F.sum("cnt").over(order))
        .withColumn("n", F.sum("cnt").over(Window.partitionBy(*keys)))
        .withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("point") * F.col("n")))
    return ranked.filter((rank <= F.col("_to")) & (rank > F.col("_to") - F.col("cnt"))).select(
        *keys, "point", F.col("_top").cast("int").alias("leaf"), "n"
    )
