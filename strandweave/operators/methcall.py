"""Calling methylation states: reads against the reference, base by base.

A reference is a table of chunks (``chrom``, ``chunk``, ``seq`` of ``CHUNK`` bases from position ``chunk * CHUNK`` on). A read meets the
chunks it touches by an equi-join on chromosome and chunk, so a chromosome with most reads is spread over its chunks;
its bases are compared as arrays inside its row, without a row per base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1024


def consensus(votes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of a reference that reads agree on. ``votes`` has ``chrom``, ``pos`` and ``base``; each position gets the base with
    most votes, of equals the least letter, and N where there is none."""
    counts = votes.filter(F.col("base").isin("A", "C", "G", "T")).groupBy("chrom", "pos", "base").agg(F.count("*").alias("_n"))
    best = counts.groupBy("chrom", "pos").agg(F.max_by("base", F.struct("_n", (-F.ascii("base")).alias("_b"))).alias("base"))
    placed = best.groupBy("chrom", F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("pos") % chunk).cast("int").alias("at"), "base"))).alias("p")
    )
    before = lambda i: F.when(i > 0, F.get(F.col("p"), i - 1)["at"]).otherwise(-1)
    pieces = F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("N"), x["at"] - before(i) - 1), x["base"]))
    return placed.select("chrom", "chunk", F.rpad(F.array_join(pieces, ""), chunk, "N").alias("seq"))


def attach_reference(reads: DataFrame, chunks: DataFrame, start: str, end: str, chunk: int = CHUNK, flank: int = 2) -> DataFrame:
    """``reads`` (with ``read_id`` and ``chrom``; one row per read) with ``_ref``, the bases from ``flank`` before ``start`` to as many behind
    ``end``; N where the reference has none."""
    lo, hi = F.col(start) - flank, F.col(end) + flank
    touched = reads.withColumn("_k", F.explode(F.sequence(F.floor(lo / chunk), F.floor(hi / chunk))))
    known = chunks.select(F.col("chrom").alias("_c"), F.col("chunk").alias("_ck"), F.col("seq").alias("_s"))
    met = touched.join(known, (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_ck")), "left")
    own = [c for c in reads.columns if c != "read_id"]
    parts = met.groupBy("read_id").agg(
        *[F.first(c).alias(c) for c in own], F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_s", F.lit("N" * chunk)).alias("_s")))).alias("_p")
    )
    at = (lo - F.get("_p", F.lit(0))["_k"] * chunk + 1).cast("int")
    return parts.withColumn("_ref", F.substring(F.array_join(F.col("_p")["_s"], ""), at, (hi - lo + 1).cast("int"))).drop("_p")


def _context(one: Column, two: Column, letter: str) -> Column:
    return F.when(one == letter, "Z").when(two == letter, "X").otherwise("H")


def _called(plus: Column, base: Column, ref: Column, after: tuple[Column, Column], before: tuple[Column, Column]) -> Column:
    """The state of an aligned base: Z, X or H (CG, CHG or CHH) for a methylated cytosine of the read's strand, the small
    letter for a converted one, ``=`` for any other match, else the read's base."""
    kept = F.when(plus, base == "C").otherwise(base == "G")
    turned = F.when(plus, base == "T").otherwise(base == "A")
    cytosine = F.when(plus, ref == "C").otherwise(ref == "G")
    context = F.when(plus, _context(*after, "G")).otherwise(_context(*before, "C"))
    return F.when(cytosine & kept, context).when(cytosine & turned, F.lower(context)).when(base == ref, "=").otherwise(base)


def call_states(reads: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``reads`` (read_id, chrom, strand, start_pos, end_pos, cigar, seq) with ``state``, a letter for each base and for each deleted
    one (I, S and D for inserted, clipped and deleted bases), ``placed``, the read's bases by reference place (``-`` for a deleted
    one), and ``original``, the bases before conversion.

    Reads without a strand or bases, or with other operations than M, I, D and S, are left out.
    """
    usable = reads.filter(F.col("strand").isNotNull() & F.col("seq").isNotNull() & F.col("cigar").rlike("^([0-9]+[MIDS])+$"))
    met = attach_reference(usable, chunks, "start_pos", "end_pos", chunk)
    met = met.withColumns({"_b": F.split(F.upper("seq"), ""), "_g": F.split("_ref", "")})
    b, g = F.col("_b"), F.col("_g")
    plus = F.col("strand") == "+"
    steps = F.zip_with(
        F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDS]"), F.lit(1)), F.regexp_extract_all("cigar", F.lit("[0-9]+([MIDS])"), F.lit(1)),
        lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")),
    )

    def place(i: Column, at: Column) -> Column:
        near = lambda d: F.get(g, at + 2 + d)
        return _called(plus, F.get(b, i), near(0), (near(1), near(2)), (near(-1), near(-2)))

    def step(a: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        run = F.transform(F.sequence(F.lit(0), n - 1), lambda i: place(a["r"] + i, a["g"] + i))
        here = F.when(n == 0, F.lit("")).when(op == "M", F.array_join(run, "", "N")).otherwise(F.repeat(op, n))
        return F.struct(
            F.when(op == "D", a["r"]).otherwise(a["r"] + n).alias("r"),
            F.when(op.isin("M", "D"), a["g"] + n).otherwise(a["g"]).alias("g"),
            F.concat(a["s"], here).alias("s"),
            F.concat(a["p"], F.when(op == "M", F.substring(F.upper("seq"), a["r"] + 1, n)).when(op == "D", F.repeat(F.lit("-"), n)).otherwise("")).alias("p"),
        )

    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit("").alias("s"), F.lit("").alias("p"))
    called = met.withColumn("_a", F.aggregate(steps, start, step)).withColumns({"state": F.col("_a.s"), "placed": F.col("_a.p")})
    # a converted base is written as it was; deleted bases have no place in the read
    bases = F.split(F.regexp_replace("state", "D", ""), "")
    was = F.zip_with(b, bases, lambda x, s: F.when(s.isin("z", "x", "h"), F.when(plus, "C").otherwise("G")).otherwise(x))
    return called.withColumn("original", F.array_join(was, "")).select(*reads.columns, "state", "placed", "original")


def state_counts(called: DataFrame) -> DataFrame:
    """Per site of a cytosine that reads of its strand call: ``chrom``, ``strand``, ``pos``, ``context``, ``mc`` and ``cov``, and of the other
    strand's reads ``rev_g``, those with the unchanged base there, and ``rev_ga``, those with it or its conversion."""
    pairs = F.arrays_zip(F.split(F.regexp_replace("state", "[IS]", ""), "").alias("s"), F.split("placed", "").alias("b"))
    each = called.select("chrom", "strand", "start_pos", F.posexplode(pairs).alias("i", "x"))
    x, upper = F.col("x.s"), F.upper(F.col("x.s"))
    base = each.select("chrom", "strand", (F.col("start_pos") + F.col("i")).alias("pos"), x.alias("s"), upper.alias("u"), F.col("x.b").alias("b"))
    calls = F.col("u").isin("Z", "X", "H")
    counts = base.groupBy("chrom", "pos").agg(
        *[
            f.alias(f"{n}_{name}")
            for sign, name in (("+", "p"), ("-", "m"))
            for n, f in (
                ("mc", F.count_if(calls & (F.col("strand") == sign) & (F.col("s") == F.col("u")))),
                ("cov", F.count_if(calls & (F.col("strand") == sign))),
                ("ctx", F.max(F.when(calls & (F.col("strand") == sign), F.col("u")))),
            )
        ],
        # seen from the other strand, a plus cytosine stays C (T if it is a variant), a minus one G (A)
        F.count_if((F.col("strand") == "-") & (F.col("b") == "C")).alias("g_p"),
        F.count_if((F.col("strand") == "-") & F.col("b").isin("C", "T")).alias("ga_p"),
        F.count_if((F.col("strand") == "+") & (F.col("b") == "G")).alias("g_m"),
        F.count_if((F.col("strand") == "+") & F.col("b").isin("G", "A")).alias("ga_m"),
    )
    side = lambda sign, n: F.when(
        F.col(f"cov_{n}") > 0,
        F.struct(
            F.lit(sign).alias("strand"), F.col(f"ctx_{n}").alias("ctx"), F.col(f"mc_{n}").alias("mc"), F.col(f"cov_{n}").alias("cov"),
            F.col(f"g_{n}").alias("rev_g"), F.col(f"ga_{n}").alias("rev_ga"),
        ),
    )
    out = counts.select("chrom", "pos", F.explode(F.array(side("+", "p"), side("-", "m"))).alias("x")).filter(F.col("x").isNotNull())
    context = F.when(F.col("x.ctx") == "Z", "CG").when(F.col("x.ctx") == "X", "CHG").otherwise("CHH")
    return out.select("chrom", "x.strand", "pos", context.alias("context"), "x.mc", "x.cov", "x.rev_g", "x.rev_ga")
