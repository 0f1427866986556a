"""Consolidating pairwise links into groups.

Records and links form a graph whose connected components are the groups. Degree-one vertices are stripped, chains of
degree-two vertices are compressed to one edge by list ranking (pointer doubling), and this is repeated while it
shrinks the graph; the core that remains is solved by alternating star contraction; labels are then given back to the
removed vertices in reverse order.

Scale: every step is a grouping or an equi-join of edge rows. Degrees and up to two neighbours of a vertex come from
one aggregation with map-side combining, so a hub is never gathered; edges are removed by joins on both their ends,
which no hub can skew; a chain vertex is reached from one other at each doubling. Where many rows meet one parent or
group, the heavy ones (fewer than ``HEAVY``, by their share of the rows) are joined by broadcast, the others by shuffle.
Each step is written as a table, with its counts taken on the way, and tables that no later step reads are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_counted, cut_lineage, release

HEAVY = 1000
LIGHT = 10_000  # rows of a key that any task can take


def join_by_share(left: DataFrame, total: int, right: DataFrame, key: str, unique: str, how: str = "inner") -> DataFrame:
    """``left`` (a table of ``total`` rows) joined with ``right``, whose ``unique`` column has no repeats, on ``key`` = ``unique``.

    Keys with more than a ``HEAVY``-th of the rows of ``left`` (and ``LIGHT`` rows) are joined by broadcast: there are fewer
    than ``HEAVY`` of them, whatever the size.
    """
    at = F.col(key) == F.col(unique)
    if total <= LIGHT:
        return left.join(right, at, how)
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    heavy, seen = cut_counted(counts.filter(F.col("_n") > max(total // HEAVY, LIGHT)).select(F.col(key).alias("_hk")), n=F.count("*"))
    if not seen["n"]:
        release(heavy)
        return left.join(right, at, how)
    few = right.join(F.broadcast(heavy), F.col(unique) == F.col("_hk"), "left_semi")
    marked = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    hot = marked.filter(F.col("_hk").isNotNull()).drop("_hk").join(F.broadcast(few), at, how)
    return hot.unionByName(marked.filter(F.col("_hk").isNull()).drop("_hk").join(right, at, how))


def member_edges(df: DataFrame, group: Column, member: Column) -> DataFrame:
    """Edges ``a`` < ``b`` that connect all members of each group, one fewer than members: a star around the least one.

    The least members come from an aggregation with map-side combining, and a group that holds many of the rows meets its
    own by broadcast, so no group is gathered in one task. Null groups and members are left out.
    """
    rows = df.select(group.alias("g"), member.cast("long").alias("b")).filter(F.col("g").isNotNull() & F.col("b").isNotNull())
    rows, seen = cut_counted(rows, n=F.count("*"))
    least = rows.groupBy(F.col("g").alias("_g")).agg(F.min("b").alias("a"))
    return join_by_share(rows, seen["n"], least, "g", "_g").filter("a < b").select("a", "b").distinct()


def _canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w"))
        .filter(F.col("u") < F.col("w"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    pair = lambda x, y: F.struct(F.col(x).alias("v"), F.col(y).alias("n"))
    return edges.select(F.inline(F.array(pair("u", "w"), pair("w", "u"))))


def _ends(edges: DataFrame) -> DataFrame:
    """Each vertex with its degree, least and greatest neighbour."""
    return _both_ways(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("n").alias("n1"), F.max("n").alias("n2"))


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Without degree-one vertices: (child, parent) of those, the edges left and their number. Of an edge alone, the
    greater end goes."""
    leaves = _ends(edges).filter("deg = 1")
    cut = (
        leaves.groupBy(F.least("v", "n1").alias("u"), F.greatest("v", "n1").alias("w"))
        .agg(F.max("v").alias("child"))
        .withColumn("parent", F.when(F.col("child") == F.col("w"), F.col("u")).otherwise(F.col("w")))
    )
    cut = cut_lineage(cut)
    left, seen = cut_counted(edges.join(cut, ["u", "w"], "left_anti"), n=F.count("*"))
    return cut, left, seen["n"]


def _rank_chains(inner: DataFrame) -> DataFrame:
    """For each degree-two vertex: the ends ``e1`` and ``e2`` of its chain, or in a pure cycle (``cyclic``) its least id ``low``.

    A dart is a vertex with one of its directions; each doubling moves it to where the dart it points to points to. It ends
    when no dart has a next one, or when the least ids seen in cycles no longer change.
    """
    dart = lambda x, y: F.struct("v", F.col(x).alias("first"), F.col(y).alias("other"))
    darts = inner.select(F.inline(F.array(dart("n1", "n2"), dart("n2", "n1"))))
    on = darts.select(F.col("v").alias("rv"), F.col("other").alias("rother"), F.col("first").alias("nxt"))
    open_ones = {"n": F.count("nxt"), "low": F.sum(F.when(F.col("nxt").isNotNull(), F.col("low")).cast("decimal(38,0)"))}
    state, now = cut_counted(
        darts.join(on, (F.col("first") == F.col("rv")) & (F.col("v") == F.col("rother")), "left").select(
            "v", "first", F.col("first").alias("cur"), "nxt", F.col("v").alias("low")
        ),
        **open_ones,
    )
    before = None
    while now["n"] and now != before:
        to = state.select(
            F.col("v").alias("rv"), F.col("first").alias("rfirst"), F.col("cur").alias("rcur"), F.col("nxt").alias("rnxt"), F.col("low").alias("rlow")
        )
        moved = state.join(to, (F.col("cur") == F.col("rv")) & (F.col("nxt") == F.col("rfirst")), "left")
        jumps = F.col("rv").isNotNull()
        moved = moved.select(
            "v",
            "first",
            F.when(jumps, F.col("rcur")).otherwise(F.col("cur")).alias("cur"),
            F.when(jumps, F.col("rnxt")).alias("nxt"),
            F.least("low", "rlow").alias("low"),
        )
        before, old = now, state
        state, now = cut_counted(moved, **open_ones)
        release(old)
    ranked = state.groupBy("v").agg(
        F.min("cur").alias("e1"), F.max("cur").alias("e2"), F.max(F.col("nxt").isNotNull()).alias("cyclic"), F.min("low").alias("low")
    )
    ranked = cut_lineage(ranked)
    release(state)
    return ranked


def _compress(edges: DataFrame, n: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Chains as single edges: (child, parent) of the vertices inside chains, the edges left and their number."""
    inner, seen = cut_counted(_ends(edges).filter("deg = 2").select("v", "n1", "n2"), n=F.count("*"))
    if not seen["n"]:
        release(inner)
        return None, edges, n
    ranked = _rank_chains(inner)
    parent = F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("e1"))
    attached = ranked.select(F.col("v").alias("child"), parent.alias("parent")).filter("child <> parent")
    gone = inner.select("v", F.explode(F.array("n1", "n2")).alias("n"))
    left = edges.join(_canonical(gone, "v", "n"), ["u", "w"], "left_anti")
    links = ranked.filter(~F.col("cyclic") & (F.col("e1") < F.col("e2"))).select(F.col("e1").alias("u"), F.col("e2").alias("w"))
    left, seen = cut_counted(left.unionAll(links).distinct(), n=F.count("*"))
    attached = cut_lineage(attached)
    release(edges, inner, ranked)
    return attached, left, seen["n"]


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """``w`` and its root ``u`` for all but the root of each component of the core, by alternating large and small stars."""
    state = {"n": F.count("*"), "sum": F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))}
    seen = None
    while True:
        least = _both_ways(edges).groupBy("v").agg(F.min("n").alias("m")).select(F.col("v").alias("lv"), F.least("v", "m").alias("m"))
        large = cut_lineage(join_by_share(edges, n, least, "u", "lv").select(F.col("m").alias("u"), "w").distinct())
        down = large.groupBy("w").agg(F.min("u").alias("m")).select(F.col("w").alias("lw"), "m")
        small = (
            large.join(down, F.col("w") == F.col("lw"))
            .filter("u <> m")
            .select(F.least("m", "u").alias("u"), F.greatest("m", "u").alias("w"))
            .unionAll(down.select(F.col("m").alias("u"), F.col("lw").alias("w")))
        )
        old = edges
        edges, now = cut_counted(small.distinct(), **state)
        release(old, large)
        if now == seen:
            return edges
        seen, n = now, now["n"]


def connected_groups(
    edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 12, keep: float = 0.7, core: float = 0.2
) -> DataFrame:
    """``group_id`` and ``member`` of every record with a link to another one; ``group_id`` is the least member.

    Repeated links, links in both directions, links of a record to itself and null ends change nothing; an empty input
    gives an empty result. Rounds of stripping and compressing end when one leaves more than ``keep`` of the edges, or at
    most ``core`` of those at the start, of which the stars then take less work than another round.
    """
    edges, seen = cut_counted(_canonical(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "a", "b"), n=F.count("*"))
    attached: list[DataFrame] = []
    n = start = seen["n"]
    for _ in range(max_rounds):
        if not n:
            break
        old, before = edges, n
        leaves, edges, n = _strip(old)
        release(old)
        inside, edges, n = _compress(edges, n)
        attached += [x for x in (leaves, inside) if x is not None]
        if n > keep * before or n <= core * start:
            break
    table = _stars(edges, n) if n else edges
    labels = table.select(F.col("w").alias("v"), F.col("u").alias("root"))
    for pairs in reversed(attached):
        known = labels.select(F.col("v").alias("kv"), "root")
        back = join_by_share(pairs.select("child", "parent"), pairs.count(), known, "parent", "kv", "left").select(
            F.col("child").alias("v"), F.coalesce("root", "parent").alias("root")
        )
        labels = cut_lineage(labels.unionAll(back))
        release(pairs, table)
        table = labels
    least = labels.groupBy("root").agg(F.min("v").alias("m")).select(F.col("root").alias("r"), F.least("root", "m").alias("group_id"))
    least = cut_lineage(least)
    members, seen = cut_counted(labels.unionAll(least.select(F.col("r").alias("v"), F.col("r").alias("root"))), n=F.count("*"))
    release(table)
    return join_by_share(members, seen["n"], least, "root", "r").select("group_id", F.col("v").alias("member"))
