"""Inserted and deleted bases: those of reads, their rightmost place in the reference, and reads held against both alleles.

An indel has ``chrom``, ``pos`` (the first deleted base, or the base that follows the inserted ones), ``n_deleted`` and ``inserted``
(upper case; empty for a deletion). Indels and reads meet reference chunks by equi-joins, so a chromosome with most rows is
spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators.methcall import CHUNK, attach_reference
from strandweave.operators.rangejoin import bin_join
from strandweave.session import cut_counted, cut_lineage

WINDOW = 64
FLANK = 12
ERROR = 0.01  # of a base
GAP = 1e-4  # to insert or to leave out a base
MOST_QUALITY = 60.0
INDEL = ["chrom", "pos", "n_deleted", "inserted"]


def read_indels(reads: DataFrame) -> DataFrame:
    """One row per inserted or deleted run of each read (read_id, chrom, start_pos, cigar, seq): read_id and the indel. Reads
    without a CIGAR string or bases have none; a run before the first aligned base has no place and is left out."""
    lens = F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDSN]"), F.lit(1))
    ops = F.regexp_extract_all("cigar", F.lit("[0-9]+([MIDSN])"), F.lit(1))
    kind = "array<struct<op:string,read_at:int,ref_at:int,len:int>>"
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.array().cast(kind).alias("x"))

    def step(a, s):
        n, op = s["n"], s["op"]
        found = op.isin("I", "D") & (a["g"] > 0) & (n > 0)
        here = F.array(F.struct(op.alias("op"), a["r"].alias("read_at"), a["g"].alias("ref_at"), n.alias("len")))
        return F.struct(
            F.when(op.isin("M", "I", "S"), a["r"] + n).otherwise(a["r"]).alias("r"),
            F.when(op.isin("M", "D", "N"), a["g"] + n).otherwise(a["g"]).alias("g"),
            F.when(found, F.concat(a["x"], here)).otherwise(a["x"]).alias("x"),
        )

    steps = F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))
    rows = reads.filter(F.col("cigar").rlike("[0-9][ID]") & F.col("seq").isNotNull()).select("read_id", "chrom", "start_pos", "seq", F.explode(F.aggregate(steps, start, step)["x"]).alias("x"))
    deleted = F.col("x.op") == "D"
    return rows.select(
        "read_id", "chrom", (F.col("start_pos") + F.col("x.ref_at")).alias("pos"), F.when(deleted, F.col("x.len")).otherwise(0).alias("n_deleted"),
        F.when(deleted, "").otherwise(F.upper(F.expr("substring(seq, x.read_at + 1, x.len)"))).alias("inserted"),
    )


def right_shift(indels: DataFrame, chunks: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """Different indels with ``shift``, how far each can be moved to the right without changing the sequence. Bases are compared
    ``window`` at a time; indels that all of them let pass go on, with the inserted bases turned by as many. Unknown bases stop."""
    todo = cut_lineage(indels.select(*INDEL).distinct().withColumns({"_pos": F.col("pos"), "_ins": F.col("inserted"), "shift": F.lit(0).cast("long")}))
    done = None
    while True:
        keyed = todo.withColumns({"read_id": F.concat_ws(":", "chrom", "pos", "n_deleted", "inserted"), "_e": F.col("_pos") + F.col("n_deleted") + window - 1})
        met = attach_reference(keyed, chunks, "_pos", "_e", chunk, flank=0)
        moved = F.when(F.col("n_deleted") > 0, F.expr("substring(_ref, n_deleted + 1)")).otherwise(F.concat("_ins", "_ref"))
        at = lambda c, i: F.substring(c, i + 1, F.lit(1))
        same = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: (at(F.col("_ref"), i) == at(F.col("_m"), i)) & (at(F.col("_ref"), i) != "N"))
        first = F.array_position(same, False)
        step = F.when(first > 0, first - 1).otherwise(window)
        turn = F.lit(window) % F.greatest(F.length("_ins"), F.lit(1))
        turned = F.concat(F.substring("_ins", turn + 1, F.length("_ins")), F.substring("_ins", F.lit(1), turn))
        out = met.withColumn("_m", moved).withColumn("_n", step)
        out, seen = cut_counted(
            out.select(*INDEL, (F.col("_pos") + F.col("_n")).alias("_pos"), turned.alias("_ins"), (F.col("shift") + F.col("_n")).alias("shift"), (F.col("_n") == window).alias("_on")),
            on=F.count_if(F.col("_on")),
        )
        ready = out.filter(~F.col("_on")).select(*INDEL, "shift")
        done = ready if done is None else done.unionByName(ready)
        if not seen["on"]:
            return done
        todo = out.filter("_on").drop("_on")


def log_scores(reads: list[str], haplotypes: list[str], error: float = ERROR, gap: float = GAP) -> np.ndarray:
    """Base-10 log scores of the best global alignment of each read with its haplotype; all pairs of a batch go through the
    table together. An unknown base scores as a match."""
    if not reads:
        return np.zeros(0)
    text = lambda xs: np.array([list(x.encode().ljust(max(map(len, xs)), b" ")) for x in xs], np.uint8).reshape(len(xs), -1)
    a, b = text(reads), text(haplotypes)
    la, lb = np.array([len(x) for x in reads]), np.array([len(x) for x in haplotypes])
    hit, miss, skip, unknown = np.log10(1 - error), np.log10(error / 3), np.log10(gap), ord("N")
    row = np.tile(np.arange(b.shape[1] + 1) * skip, (len(a), 1))
    best = np.where(la == 0, row[np.arange(len(a)), lb], 0.0)
    for i in range(a.shape[1]):
        x = a[:, i : i + 1]
        pair = np.where((x == b) | (x == unknown) | (b == unknown), hit, miss)
        open_ = np.maximum(row[:, :-1] + pair, row[:, 1:] + skip)
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + skip
        for j in range(b.shape[1]):
            new[:, j + 1] = np.maximum(open_[:, j], new[:, j] + skip)
        row = new
        last = la == i + 1
        best[last] = row[last, lb[last]]
    return best


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        bases, kept = t["_read"].to_pylist(), [n for n in t.column_names if not n.startswith("_")]
        ref, alt = log_scores(bases, t["_hap0"].to_pylist()), log_scores(bases, t["_hap1"].to_pylist())
        yield from t.select(kept).append_column("ll0", pa.array(ref)).append_column("ll1", pa.array(alt)).to_batches()


def realign(indels: DataFrame, reads: DataFrame, chunks: DataFrame, flank: int = FLANK, chunk: int = CHUNK) -> DataFrame:
    """Each read (read_id, chrom, start_pos, end_pos, cigar, seq; one row per read) over each different indel with aligned bases on both sides:
    ``read_id``, the indel, the log scores ``ll0`` and ``ll1`` of the read's bases around it against the reference and against the
    indel, ``allele`` (the better; null if equal) and ``qv``, the Phred quality of that choice.

    The bases held against both are those within ``flank`` of the indel, as the CIGAR string places them, so a read whose
    aligner put the indel elsewhere nearby is still told right. Windows are short rows; alignment runs per Arrow batch.
    """
    usable = reads.filter(F.col("seq").isNotNull() & F.col("cigar").rlike("[0-9]M"))
    places = indels.select(*INDEL).distinct().withColumns({"_first": F.col("pos") - 1, "_last": F.col("pos") + F.col("n_deleted")}).withColumnRenamed("chrom", "_chrom")
    spans = attach_reference(usable.select("read_id", "chrom", "start_pos", "end_pos", "cigar", "seq"), chunks, "start_pos", "end_pos", chunk, flank=0)
    blocks = spans.withColumn("_b", fr.aligned_blocks(F.col("cigar"))).drop("cigar")
    met = bin_join(places.withColumnRenamed("_chrom", "chrom"), blocks, ["chrom"], "_first", "start_pos", "end_pos", 500).filter("_last <= end_pos")
    lo, hi = F.greatest(F.col("_first") - flank + 1, F.col("start_pos")), F.least(F.col("_last") + flank - 1, F.col("end_pos"))
    met = met.withColumns({"_lo": lo - F.col("start_pos"), "_hi": hi - F.col("start_pos")})
    from_ = F.array_min(F.transform(F.filter("_b", lambda x: x["ref_at"] + x["len"] > F.col("_lo")), lambda x: x["read_at"] + F.greatest(F.lit(0), F.col("_lo") - x["ref_at"])))
    to = F.array_max(F.transform(F.filter("_b", lambda x: x["ref_at"] <= F.col("_hi")), lambda x: x["read_at"] + F.least(x["len"] - 1, F.col("_hi") - x["ref_at"])))
    met = met.withColumns({"_from": from_.cast("int"), "_to": to.cast("int")}).filter(F.col("_from") <= F.col("_to"))
    piece = lambda c, a, b: F.substring(c, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    at = F.col("pos") - F.col("start_pos")
    windows = met.select(
        "read_id", *INDEL, piece(F.upper("seq"), F.col("_from"), F.col("_to") + 1).alias("_read"), piece(F.col("_ref"), F.col("_lo"), F.col("_hi") + 1).alias("_hap0"),
        F.concat(piece(F.col("_ref"), F.col("_lo"), at), "inserted", piece(F.col("_ref"), at + F.col("n_deleted"), F.col("_hi") + 1)).alias("_hap1"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema if not f.name.startswith("_"))
    scored = windows.mapInArrow(_score_batches, f"{kept}, ll0 double, ll1 double")
    d = F.abs(F.col("ll1") - F.col("ll0"))
    allele = F.when(F.col("ll1") > F.col("ll0") + 1e-9, 1).when(F.col("ll0") > F.col("ll1") + 1e-9, 0)
    quality = F.least(F.lit(MOST_QUALITY), F.round(10 * F.log10(1 + F.pow(F.lit(10.0), F.least(d, F.lit(300.0)))), 2))
    return scored.withColumns({"allele": allele, "qv": quality})
