"""Haplotype fragments: runs, variant graphs, blocks, likelihoods and phasing.

``calls`` frames have frag_id, varid, allele (0 or 1) and qv, one row per fragment and variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import attach
from strandweave.operators.rangejoin import previous, running_total, runs
from strandweave.session import cut_counted, cut_lineage, release

LEAST_QV = 6
CHUNK = 1 << 16


def merge_mates(rows: DataFrame) -> DataFrame:
    """Calls of both mates as one per variant: agreeing ones keep the better quality, contradicting ones are dropped."""
    return (
        rows.groupBy("frag_id", "varid")
        .agg(F.min("allele").alias("allele"), F.max("allele").alias("_other"), F.max("qv").alias("qv"))
        .filter("allele = _other")
        .drop("_other")
    )


def link_barcodes(rows: DataFrame, most: int = 93) -> DataFrame:
    """Calls of the reads of one molecule (``mol_id``): qualities of agreeing calls add up to ``most``, contradicting
    ones are dropped."""
    return (
        rows.groupBy("mol_id", "varid")
        .agg(F.min("allele").alias("allele"), F.max("allele").alias("_other"), F.least(F.sum("qv"), F.lit(most)).alias("qv"))
        .filter("allele = _other")
        .drop("_other")
    )


def fragment_runs(calls: DataFrame) -> DataFrame:
    """The file form of fragments: per fragment, how many runs of consecutive variants it has, their starts and
    alleles, and all qualities."""
    run = runs(calls, ["frag_id"], "varid").groupBy("frag_id", "run_id").agg(
        F.min("varid").alias("start"), F.sort_array(F.collect_list(F.struct("varid", "allele", "qv"))).alias("c")
    )
    ordered = F.sort_array(F.collect_list(F.struct("start", "c")))
    parts = run.groupBy("frag_id").agg(ordered.alias("r"))
    text = F.transform("r", lambda r: F.concat(r["start"].cast("string"), F.lit(" "), F.concat_ws("", F.transform(r["c"], lambda c: c["allele"].cast("string")))))
    quals = F.flatten(F.transform("r", lambda r: F.transform(r["c"], lambda c: F.chr(F.least(c["qv"], F.lit(93)) + 33))))
    return parts.select("frag_id", F.size("r").alias("n_blocks"), F.concat_ws(" ", text).alias("runs"), F.concat_ws("", quals).alias("quals"))


def path_edges(calls: DataFrame) -> DataFrame:
    """Edges of neighbouring variants in a fragment, counted: ``a`` < ``b``, ``same`` and ``other`` fragments."""
    w = Window.partitionBy("frag_id").orderBy("varid")
    edges = calls.select(
        F.col("varid").alias("a"), F.lead("varid").over(w).alias("b"), "allele", F.lead("allele").over(w).alias("_next")
    ).filter(F.col("b").isNotNull())
    return edges.groupBy("a", "b").agg(F.count_if(F.col("allele") == F.col("_next")).alias("same"), F.count_if(F.col("allele") != F.col("_next")).alias("other"))


def clique_edges(calls: DataFrame, chunk: int = 64) -> DataFrame:
    """Edges of all pairs of variants in a fragment, counted: ``a`` < ``b``, ``same`` and ``other`` fragments.

    A fragment's calls are numbered in chunks of ``chunk`` and joined by fragment and pair of chunks, so the pairs of a long
    fragment are spread over tasks: each call is copied once per chunk of its fragment, and a group has at most
    ``chunk ** 2`` pairs, which are counted before the shuffle.
    """
    w = Window.partitionBy("frag_id")
    rows = calls.select("frag_id", "varid", "allele", F.floor((F.row_number().over(w.orderBy("varid")) - 1) / chunk).alias("_c"))
    rows = rows.withColumn("_last", F.max("_c").over(w))
    one = rows.select("frag_id", F.col("varid").alias("a"), "allele", "_c", F.explode(F.sequence("_c", "_last")).alias("_d"))
    two = rows.select(
        F.col("frag_id").alias("_f"), F.col("varid").alias("b"), F.col("allele").alias("_other"), F.col("_c").alias("_e"),
        F.explode(F.sequence(F.lit(0).cast("long"), "_c")).alias("_b"),
    )
    at = (F.col("frag_id") == F.col("_f")) & (F.col("_c") == F.col("_b")) & (F.col("_d") == F.col("_e")) & (F.col("a") < F.col("b"))
    fits = F.col("allele") == F.col("_other")
    return one.join(two, at).groupBy("a", "b").agg(F.count_if(fits).alias("same"), F.count_if(~fits).alias("other"))


def allele_depth(calls: DataFrame) -> DataFrame:
    return calls.groupBy("varid").agg(F.count_if(F.col("allele") == 0).alias("n0"), F.count_if(F.col("allele") == 1).alias("n1"), F.sum("qv").alias("qv"))


def spanning_blocks(calls: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``varid`` and ``block_id``: runs of variants in file order that fragments span without a break. A block is named
    by its least variant.

    Fragments are reduced to intervals of variants; a block starts at an interval whose start is beyond all ends before
    it. The running maximum is taken per chunk of variants and carried over on one row per chunk.
    """
    spans = calls.groupBy("frag_id").agg(F.min("varid").alias("s"), F.max("varid").alias("e")).filter("s < e")
    reach = spans.groupBy("s").agg(F.max("e").alias("e")).withColumn("_c", F.floor(F.col("s") / chunk))
    per = reach.groupBy("_c").agg(F.max("e").alias("_m"))
    carry = per.select(F.col("_c").alias("_cc"), F.max("_m").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy("_c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        reach.join(carry, F.col("_c") == F.col("_cc"))
        .withColumn("_before", F.greatest("_carry", F.max("e").over(w)))
        .filter(F.col("_before").isNull() | (F.col("s") > F.col("_before")))
        .select(F.col("s").alias("head"), "_c")
    )
    seen = calls.join(spans.select("frag_id"), "frag_id", "left_semi").select("varid").distinct().withColumn("_c", F.floor(F.col("varid") / chunk))
    last = heads.groupBy("_c").agg(F.max("head").alias("_h"))
    marks = seen.select("varid", "_c", F.lit(None).cast("long").alias("head")).unionAll(heads.select(F.col("head").alias("varid"), "_c", "head"))
    marked = marks.groupBy("varid", "_c").agg(F.max("head").alias("head"))
    chunks = seen.select("_c").distinct().join(last, "_c", "left")
    earlier = chunks.select(F.col("_c").alias("_cc"), F.max("_h").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_eh"))
    inside = Window.partitionBy("_c").orderBy("varid").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(earlier, F.col("_c") == F.col("_cc")).select("varid", F.coalesce(F.max("head").over(inside), "_eh").alias("block_id"))


def block_summary(blocks: DataFrame, variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Per block: first variant, length in variants, phased variants, span in bases and fragments."""
    placed = blocks.join(variants.select("varid", "position"), "varid", "left")
    shape = placed.groupBy("block_id").agg(
        (F.max("varid") - F.min("varid") + 1).alias("len"), F.count("*").alias("phased"), (F.max("position") - F.min("position")).alias("span")
    )
    frags = calls.join(blocks, "varid").groupBy("frag_id", "block_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    return shape.join(frags.groupBy("block_id").agg(F.count("*").alias("fragments")), "block_id", "left").select(
        "block_id", "len", "phased", "span", F.coalesce("fragments", F.lit(0)).alias("fragments")
    )


def log_likelihood(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """``frag_id`` and ``ll``: log10 of P(fragment | h) + P(fragment | complement) for phased variants (varid, hap)."""
    e = F.pow(F.lit(10.0), -F.col("qv") / 10.0)
    rows = calls.filter(F.col("qv") >= LEAST_QV).join(haplotype, "varid")
    fits = F.col("allele") == F.col("hap")
    one = F.sum(F.log10(F.when(fits, 1 - e).otherwise(e)))
    two = F.sum(F.log10(F.when(fits, e).otherwise(1 - e)))
    top = F.greatest("_1", "_2")
    total = top + F.log10(F.pow(F.lit(10.0), F.col("_1") - top) + F.pow(F.lit(10.0), F.col("_2") - top))
    return rows.groupBy("frag_id").agg(one.alias("_1"), two.alias("_2")).select("frag_id", total.alias("ll"))


def support(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """Per phased variant, the fragments for and against it: each is put to the haplotype that more of its calls fit;
    ties count for none. ``pruned`` where both sides are equal."""
    rows = calls.join(haplotype, "varid")
    fits = (F.col("allele") == F.col("hap")).cast("int")
    side = rows.groupBy("frag_id").agg(F.sum(2 * fits - 1).alias("_side"))
    votes = rows.join(side.filter("_side <> 0"), "frag_id")
    good = (2 * fits - 1) * F.signum("_side") > 0
    return votes.groupBy("varid").agg(F.count_if(good).alias("n_for"), F.count_if(~good).alias("n_against")).withColumn(
        "pruned", F.col("n_for") == F.col("n_against")
    )


def chain_phase(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """A first haplotype, ``varid``, ``block_id`` and ``hap``: along a block each variant follows the one before it, in
    the phase most fragments see between the two (0 where none do or they tie)."""
    order = previous(blocks, ["block_id"], "varid", "varid", "_prev", CHUNK)
    edges = path_edges(calls).select(F.col("a").alias("_prev"), F.col("b").alias("varid"), (F.col("other") > F.col("same")).cast("int").alias("_flip"))
    flips = order.join(edges, ["_prev", "varid"], "left")
    run = running_total(flips, ["block_id"], "varid", F.coalesce("_flip", F.lit(0)), "_run", CHUNK)
    return run.select("varid", "block_id", (F.col("_run") % 2).cast("int").alias("hap"))


def phase(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """Haplotypes by local search on whole tables: in each round, fragments take the side that fits them better, and a
    variant flips where the weight of calls against it exceeds that for it. Each flip raises the total weight of fitting
    calls, so the rounds come to an end: with the first in which no variant flips. ``varid``, ``block_id``, ``hap`` and
    ``confidence`` (share of the weight that fits)."""
    weight = F.col("qv").cast("double")
    hap = cut_lineage(chain_phase(calls, blocks))
    usable = calls.filter(F.col("qv") >= LEAST_QV)
    while True:
        rows = usable.join(hap.select("varid", "hap"), "varid")
        sign = F.when(F.col("allele") == F.col("hap"), weight).otherwise(-weight)
        side = rows.groupBy("frag_id").agg(F.when(F.sum(sign) < 0, -1).otherwise(1).alias("_side"))
        votes = rows.join(side, "frag_id").groupBy("varid").agg(F.sum(sign * F.col("_side")).alias("_v"), F.sum(weight).alias("_w"))
        old = hap
        flips = F.coalesce(F.col("_v") < 0, F.lit(False))
        hap, seen = cut_counted(
            old.drop("confidence", "_flips")
            .join(votes, "varid", "left")
            .select(
                "varid",
                "block_id",
                F.when(flips, 1 - F.col("hap")).otherwise(F.col("hap")).alias("hap"),
                F.coalesce((F.abs("_v") + F.col("_w")) / (2 * F.col("_w")), F.lit(0.5)).alias("confidence"),
                flips.alias("_flips"),
            ),
            flips=F.count_if("_flips"),
        )
        release(old)
        if not seen["flips"]:
            return hap.drop("_flips")


def _odds(qv: Column) -> Column:
    """log10 of P(wrong) / P(right) of a call."""
    e = F.pow(F.lit(10.0), -qv / 10.0)
    return F.log10(e / (1 - e))


def _log_sum(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b)."""
    top = F.greatest(a, b)
    return top + F.log10(F.pow(F.lit(10.0), a - top) + F.pow(F.lit(10.0), b - top))


def _sides(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """Calls of phased variants with ``_d``, what flipping the variant adds to log10 P(fragment | haplotype) and takes from
    that of the complement, and both likelihoods of the whole fragment, ``_1`` and ``_2``."""
    e = F.pow(F.lit(10.0), -F.col("qv") / 10.0)
    fits = F.col("allele") == F.col("hap")
    rows = calls.filter(F.col("qv") >= LEAST_QV).join(haplotype.select("varid", "hap"), "varid")
    rows = rows.withColumn("_d", F.when(fits, _odds(F.col("qv"))).otherwise(-_odds(F.col("qv"))))
    both = rows.groupBy(F.col("frag_id").alias("_f")).agg(
        F.sum(F.log10(F.when(fits, 1 - e).otherwise(e))).alias("_1"), F.sum(F.log10(F.when(fits, e).otherwise(1 - e))).alias("_2")
    )
    return rows.join(both, F.col("frag_id") == F.col("_f")).drop("_f")


def flip_gains(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """``varid``, ``gain``, how much the log10 likelihood of all fragments rises if that variant alone is flipped, and
    ``posterior``, the probability of its phase given all others. One join and two groupings, whatever the blocks."""
    now, then = _log_sum(F.col("_1"), F.col("_2")), _log_sum(F.col("_1") + F.col("_d"), F.col("_2") - F.col("_d"))
    gains = _sides(calls, haplotype).groupBy("varid").agg(F.sum(then - now).alias("gain"))
    return gains.withColumn("posterior", 1 / (1 + F.pow(F.lit(10.0), F.least("gain", F.lit(300.0)))))


def switch_gains(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """``block_id``, ``varid`` and ``gain``: how much the log10 likelihood of all fragments rises if the block is flipped from
    that variant on. A fragment adds the same to all cuts between two of its calls, so it gives two events there, and
    the gain of a cut is a running total over the block, in bins."""
    w = Window.partitionBy("frag_id").orderBy("varid")
    rows = _sides(calls, haplotype)
    # all calls from the next one on flipped
    rest = F.sum("_d").over(w.rowsBetween(1, Window.unboundedFollowing))
    then = _log_sum(F.col("_1") + rest, F.col("_2") - rest)
    cuts = rows.select("varid", F.lead("varid").over(w).alias("_next"), (then - _log_sum(F.col("_1"), F.col("_2"))).alias("_g"))
    events = cuts.filter(F.col("_next").isNotNull()).select(
        F.inline(F.array(F.struct(F.col("varid").alias("v"), F.col("_g").alias("g")), F.struct(F.col("_next").alias("v"), (-F.col("_g")).alias("g"))))
    )
    # an event at a call counts for the cuts behind it
    sums = events.groupBy(F.col("v").alias("_v")).agg(F.sum("g").alias("_g"))
    placed = haplotype.select("block_id", "varid").join(sums, F.col("varid") == F.col("_v"), "left").select("block_id", "varid", F.coalesce("_g", F.lit(0.0)).alias("_g"))
    total = running_total(placed, ["block_id"], "varid", F.col("_g"), "_t", CHUNK)
    return total.select("block_id", "varid", (F.col("_t") - F.col("_g")).alias("gain"))


def refine(calls: DataFrame, haplotype: DataFrame, least_gain: float = 1e-6) -> DataFrame:
    """``haplotype`` (varid, block_id, hap) climbed to where no flip of one variant and no flip of a block from one variant
    on raises the likelihood by ``least_gain`` or more, with ``posterior`` of each variant.

    Each round flips, in every block, the variants whose gain is the best of all that share a fragment with them, or
    else the block behind its best cut; both only raise the likelihood, so the rounds come to an end.
    """
    hap = cut_lineage(haplotype.select("varid", "block_id", "hap"))
    while True:
        gains = cut_lineage(flip_gains(calls, hap))
        better = gains.filter(F.col("gain") >= least_gain).select("varid", F.struct("gain", "varid").alias("_r"))
        met = calls.filter(F.col("qv") >= LEAST_QV).select("frag_id", "varid").join(better, "varid")
        best = met.groupBy("frag_id").agg(F.max("_r").alias("_b"))
        lost = met.join(best, "frag_id").filter(F.col("_r") != F.col("_b")).select("varid").distinct()
        flips = better.select("varid").join(lost, "varid", "left_anti").withColumn("_one", F.lit(1))
        old = hap
        hap, seen = cut_counted(
            old.join(flips, "varid", "left").select("varid", "block_id", F.when(F.col("_one") == 1, 1 - F.col("hap")).otherwise(F.col("hap")).alias("hap"), "_one"), n=F.count("_one")
        )
        hap = _without_mark(hap)
        release(old)
        if seen["n"]:
            release(gains)
            continue
        top = switch_gains(calls, hap).groupBy("block_id").agg(F.max(F.struct("gain", (-F.col("varid")).alias("v"))).alias("_t"))
        top = top.filter(F.col("_t.gain") >= least_gain).select("block_id", (-F.col("_t.v")).alias("_cut"))
        new, seen = cut_counted(
            attach(hap, top, ["block_id"], "left").select(
                "varid", "block_id", F.when(F.col("varid") >= F.col("_cut"), 1 - F.col("hap")).otherwise(F.col("hap")).alias("hap"), "_cut"
            ),
            n=F.count("_cut"),
        )
        if not seen["n"]:
            return hap.join(gains.select("varid", "posterior"), "varid", "left").select("varid", "block_id", "hap", F.coalesce("posterior", F.lit(0.5)).alias("posterior"))
        release(hap, gains)
        hap = _without_mark(new)


def _without_mark(table: DataFrame) -> DataFrame:
    out = table.select("varid", "block_id", "hap")
    out._cut_name = table._cut_name
    return out


def switch_errors(hap: DataFrame, truth: DataFrame) -> DataFrame:
    """Per block: variants compared with a true haplotype (varid, true_hap), ``switches`` and ``mismatches``. A phase
    that changes twice in a row, or at the last variant, is a mismatch; the other changes are switches."""
    x = hap.join(truth, "varid").select("block_id", "varid", (F.col("hap") != F.col("true_hap")).cast("int").alias("_x"))
    change = previous(x, ["block_id"], "varid", "_x", "_p", CHUNK).withColumn("_c", F.coalesce((F.col("_x") != F.col("_p")).cast("int"), F.lit(0)))
    flat = running_total(change, ["block_id"], "varid", 1 - F.col("_c"), "_r", CHUNK)
    ends = x.groupBy(F.col("block_id").alias("_b")).agg(F.max("varid").alias("_end"))
    run = flat.filter("_c = 1").groupBy("block_id", "_r").agg(F.count("*").alias("_n"), F.max("varid").alias("_v"))
    run = run.join(ends, F.col("block_id") == F.col("_b")).withColumn("_l", F.col("_v") == F.col("_end"))
    # a run of n changes in a row holds n // 2 mismatches and, if odd, a switch, or a mismatch at the block's end
    per = run.groupBy("block_id").agg(
        F.sum((F.col("_n") % 2) * F.when(F.col("_l"), 0).otherwise(1)).alias("switches"),
        F.sum(F.floor(F.col("_n") / 2) + (F.col("_n") % 2) * F.when(F.col("_l"), 1).otherwise(0)).alias("mismatches"),
    )
    return x.groupBy("block_id").agg(F.count("*").alias("compared")).join(per, "block_id", "left").select(
        "block_id", "compared", F.coalesce("switches", F.lit(0)).alias("switches"), F.coalesce("mismatches", F.lit(0)).alias("mismatches")
    )


def half_length(df: DataFrame, length: str, total: Column | None = None) -> DataFrame:
    """One row with ``n50``: the length at which the longest rows, added up, reach half of ``total`` (of all lengths if
    not given). Equal lengths are counted first, and the different ones are ordered in bins."""
    counts = df.groupBy(F.col(length).alias("_l")).agg(F.count("*").alias("_n"))
    counts, seen = cut_counted(counts.filter("_l > 0").withColumn("_a", -F.col("_l")), total=F.sum(F.col("_l") * F.col("_n")))
    half = (total if total is not None else F.lit(seen["total"] or 0)) / 2
    upto = running_total(counts, [], "_a", F.col("_l") * F.col("_n"), "_t", CHUNK)
    return upto.filter(F.col("_t") >= half).agg(F.max("_l").alias("n50"))
