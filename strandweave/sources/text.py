"""Text formats: each has ``parse_*``, from a frame of lines (``value``), and ``*_lines``, from rows to lines. ``read_*`` reads files.

Lines are split and typed by expressions; nothing here runs row by row in Python. Values that do not parse become null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import covered_heads
from strandweave.operators.rangejoin import previous, running_total

METHRATIO = (
    ("chrom", "string"), ("pos", "int"), ("strand", "string"), ("context", "string"), ("c_count", "int"), ("coverage", "int"),
    ("methlevel", "double"), ("eff_ct", "double"), ("rev_g", "int"), ("rev_ga", "int"), ("category", "string"), ("ctx5", "string"),
)
SAM = (
    ("read_id", "string"), ("flag", "int"), ("chrom", "string"), ("position", "int"), ("mapq", "int"), ("cigar", "string"),
    ("mate_chrom", "string"), ("mate_position", "int"), ("insert_size", "int"), ("seq", "string"), ("qual", "string"),
)
VCF = (
    ("chrom", "string"), ("position", "int"), ("id", "string"), ("ref_allele", "string"), ("alt_allele", "string"), ("qual", "int"),
    ("filter_tag", "string"), ("info", "string"), ("format", "string"), ("sample", "string"),
)
SEPARATOR = "********"
LINES = 1 << 16


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of files with the file (``_file``) and the place in it (``_at``) of the split they come from."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))


def write_lines(lines: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes ``value`` as text, in a folder for each value of the columns ``by``."""
    lines.select("value", *by).write.partitionBy(*by).text(path)


def number_lines(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Lines with their number from 1 on, in the order of the files' names and places in them; of lines that come from no
    file, in that of their partitions.

    Rows are counted per split, and the splits before it are added: one small row per split, no sort of all lines.
    """
    if "_file" not in lines.columns:
        lines = lines.withColumns({"_file": F.lit(""), "_at": F.shiftright(F.monotonically_increasing_id(), 33)})
    marked = lines.withColumn("_id", F.monotonically_increasing_id())
    counts = marked.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = counts.select(
        F.col("_file").alias("_f"), F.col("_at").alias("_a"), "_first",
        F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    met = marked.join(before, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")))
    return met.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_file", "_at", "_f", "_a", "_first", "_before")


def _columns(parts: Column, fields: tuple, start: int = 0) -> list[Column]:
    return [(F.get(parts, i + start) if t == "string" else F.get(parts, i + start).try_cast(t)).alias(n) for i, (n, t) in enumerate(fields)]


def _joined(*columns: Column | str, missing: str = ".") -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(missing)) for c in columns])


def parse_methratio(lines: DataFrame) -> DataFrame:
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    return rows.select(*_columns(F.col("p"), METHRATIO))


def methratio_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_joined(*[n for n, _ in METHRATIO], missing="null").alias("value"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment lines with the tags ``nm`` (mismatches), ``meth_state``, ``yc`` and ``yd`` (conversion and direction); header lines are
    left out."""
    rows = lines.filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    tag = lambda prefix: F.get(F.filter(F.slice("p", 12, 1000), lambda t: t.startswith(prefix)), F.lit(0))
    return rows.select(*_columns(F.col("p"), SAM), F.substring(tag("NM:i:"), 6, 1 << 30).try_cast("int").alias("nm"), F.substring(tag("MD:Z:"), 6, 1 << 30).alias("meth_state"), F.substring(tag("YC:Z:"), 6, 1 << 30).alias("yc"), F.substring(tag("YD:Z:"), 6, 1 << 30).alias("yd"))


def sam_lines(rows: DataFrame) -> DataFrame:
    tags = [F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("MD:Z:"), F.col("meth_state"))]
    tags += [F.concat(F.lit(f"{n.upper()}:Z:"), F.col(n)) for n in ("yc", "yd") if n in rows.columns]
    return rows.select(F.concat_ws("\t", _joined(*[n for n, _ in SAM], missing="*"), *tags).alias("value"))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Variant lines with ``gt``, taken from the sample by the place of GT in the format; header lines are left out."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    fields = rows.select(*_columns(F.col("p"), VCF))
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    return fields.withColumn("gt", F.when(at > 0, F.get(F.split("sample", ":"), at - 1)))


def vcf_lines(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Variant lines, with the columns ``keep`` beside them."""
    empty = F.lit(".")
    return rows.select(*keep, _joined("chrom", "position", empty, "ref_allele", "alt_allele", "qual", "filter_tag", empty, F.lit("GT"), "gt").alias("value"))


def parse_fragments(lines: DataFrame) -> DataFrame:
    """Fragment lines, old form (count, id, runs, qualities) or new (with kind, mate index and insert size behind the id),
    as one row per call: frag_id, varid, allele, qv, dtype, mate2_ix, isize. Lines without runs give no rows."""
    p = F.split("value", " ")
    rows = lines.select(p.alias("p")).withColumn("n", F.get("p", F.lit(0)).try_cast("int")).filter("n > 0")
    extra = F.size("p") - 3 - 2 * F.col("n")
    rows = rows.withColumn("new", extra == 3).filter(extra.isin(0, 3))
    first = F.when(F.col("new"), 5).otherwise(2)
    start = lambda i: F.get(F.col("p"), first + 2 * i).cast("long")
    alleles = lambda i: F.get(F.col("p"), first + 2 * i + 1)
    calls = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda i: F.transform(F.sequence(F.lit(0), F.length(alleles(i)) - 1), lambda j: F.struct((start(i) + j).alias("varid"), F.substring(alleles(i), j + 1, F.lit(1)).alias("allele"))),
        )
    )
    head = lambda k, t: F.when(F.col("new"), F.get("p", F.lit(k)).try_cast(t))
    out = rows.select(
        F.get("p", F.lit(1)).alias("frag_id"), F.posexplode(calls).alias("i", "c"), F.element_at("p", -1).alias("quals"),
        head(2, "int").alias("dtype"), head(3, "long").alias("mate2_ix"), head(4, "int").alias("isize"),
    )
    qv = F.ascii(F.substring("quals", F.col("i") + 1, F.lit(1))) - 33
    return out.select("frag_id", "c.varid", F.col("c.allele").try_cast("int").alias("allele"), qv.alias("qv"), "dtype", "mate2_ix", "isize")


def fragment_lines(runs: DataFrame) -> DataFrame:
    """Lines of the old form from ``fragment_runs``."""
    return runs.select(F.concat_ws(" ", F.col("n_blocks").cast("string"), "frag_id", "runs", "quals").alias("value"))


def fragment_lines_new(runs: DataFrame) -> DataFrame:
    """Lines of the new form from ``fragment_runs`` with dtype, mate2_ix and isize."""
    extra = [F.coalesce(F.col(c), F.lit(d)).cast("string") for c, d in (("dtype", 0), ("mate2_ix", -1), ("isize", -1))]
    return runs.select(F.concat_ws(" ", F.col("n_blocks").cast("string"), "frag_id", *extra, "runs", "quals").alias("value"))


def parse_blocks(lines: DataFrame) -> DataFrame:
    """Haplotype block files as one row per variant: block (counted from 1), varid, hap1, hap2, chrom, pos, ref, alt, gt,
    mismatch_q. Header and separator lines are left out; the header starts a block."""
    head = F.col("value").startswith("BLOCK")
    numbered = running_total(number_lines(lines), [], "line_no", head.cast("int"), "block", LINES)
    p = F.col("p")
    rows = numbered.filter(~head & ~F.col("value").startswith("*")).select("block", F.split("value", "\t").alias("p"))
    fields = (("varid", "long"), ("hap1", "string"), ("hap2", "string"), ("chrom", "string"), ("pos", "int"), ("ref", "string"), ("alt", "string"), ("gt", "string"))
    return rows.select("block", *_columns(p, fields), F.get(p, F.lit(10)).try_cast("double").alias("mismatch_q"))


def block_lines(rows: DataFrame) -> DataFrame:
    """Block files from phased rows (block_id, varid, hap, chrom, pos, ref, alt, gt, mismatch_q) with ``block_line`` for
    their order: sorted by block, the header first and a separator last. Blocks are put into ranges, and a file holds
    those of one range."""
    body = rows.select(
        F.col("block_id"), F.lit(1).alias("_k"), F.col("varid").alias("_v"),
        _joined("varid", "hap", 1 - F.col("hap"), "chrom", "pos", "ref", "alt", "gt", F.lit(0), F.lit("."), F.format_string("%.2f", F.col("mismatch_q"))).alias("value"),
    )
    shape = rows.groupBy("block_id").agg(F.min("varid").alias("o"), (F.max("varid") - F.min("varid") + 1).alias("l"), F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("s"))
    head = shape.select(
        "block_id", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_v"),
        F.concat(F.lit("BLOCK: offset: "), "o", F.lit(" len: "), "l", F.lit(" phased: "), "n", F.lit(" SPAN: "), "s").alias("value"),
    )
    tail = shape.select("block_id", F.lit(2).alias("_k"), F.lit(0).cast("long").alias("_v"), F.lit(SEPARATOR).alias("value"))
    return _in_ranges(head.unionByName(body).unionByName(tail), "block_id", ["block_id", "_k", "_v"])


def _in_ranges(rows: DataFrame, by: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return rows.repartitionByRange(*by).sortWithinPartitions(*order).select("value")


def merged_lines(rows: DataFrame) -> DataFrame:
    """Merged haplotype files from rows (block_id, chrom, pos, hap1, hap2, source): a header for each block."""
    body = rows.select("block_id", F.lit(1).alias("_k"), F.col("pos").cast("long").alias("_v"), _joined("chrom", "pos", "hap1", "hap2", "source").alias("value"))
    shape = rows.groupBy("block_id", "chrom").agg(F.min("pos").alias("s"), F.max("pos").alias("e"))
    head = shape.select("block_id", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_v"), _joined(F.lit("#Block"), "chrom", "s", "e").alias("value"))
    return _in_ranges(head.unionByName(body), "block_id", ["block_id", "_k", "_v"])


def phased_vcf_lines(rows: DataFrame) -> DataFrame:
    """Variant lines with the phase and the block in the sample: rows with hap and block_id (null where not phased)."""
    empty, hap = F.lit("."), F.col("hap")
    phase = F.when(F.col("block_id").isNotNull(), F.concat_ws(":", F.concat_ws("|", hap.cast("string"), (1 - hap).cast("string")), F.col("block_id").cast("string")))
    sample = F.concat_ws(":", F.coalesce("gt", empty), F.coalesce(phase, empty))
    return rows.select(_joined("chrom", "position", empty, "ref_allele", "alt_allele", "qual", "filter_tag", empty, F.lit("GT:SP"), sample).alias("value"))


PAIR = (
    ("chrom", "string"), ("strand", "string"), ("c1", "long"), ("c2", "long"), ("mm", "long"), ("mu", "long"), ("um", "long"), ("uu", "long"), ("p", "double"),
)


def pair_lines(pairs: DataFrame, bin_width: int = 1 << 18) -> DataFrame:
    """Pair tables in order, with a line of asterisks where a pair does not begin at the site with which the one before ends."""
    keys = ["chrom", "strand"]
    rows = previous(pairs, keys, "c1", "c2", "_p", bin_width).withColumn("_b", F.floor(F.col("c1") / bin_width))
    each = rows.select(
        *keys, "_b", "c1", F.inline(F.array(
            F.struct(F.lit(0).alias("_k"), F.when(F.col("_p") != F.col("c1"), "*" * 6).alias("value")),
            F.struct(F.lit(1).alias("_k"), _joined(*[n for n, _ in PAIR]).alias("value")),
        ))
    )
    return _in_ranges(each.filter(F.col("value").isNotNull()), [*keys, "_b"], [*keys, "c1", "_k"])


def parse_pairs(lines: DataFrame) -> DataFrame:
    rows = lines.filter(~F.col("value").rlike("^[*#]") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    return rows.select(*_columns(F.col("p"), PAIR))


REGION = (("chrom", "string"), ("start_pos", "long"), ("end_pos", "long"), ("label", "string"), ("n_sites", "long"))


def region_lines(regions: DataFrame, kind: str = "bed") -> DataFrame:
    """Regions as lines: ``bed`` (label and sites behind), ``bed4`` and ``ped3`` (strand behind), ``gtf`` or ``gff``."""
    if kind == "bed":
        return regions.select(_joined(*[n for n, _ in REGION]).alias("value"))
    if kind in ("bed4", "ped3"):
        return regions.select(_joined("chrom", "start_pos", *(["end_pos"] if kind == "bed4" else []), "strand").alias("value"))
    name = F.concat(F.lit('gene_id "'), "region_id", F.lit('";')) if kind == "gtf" else F.concat(F.lit("ID="), "region_id", F.lit(";"))
    dot = F.lit(".")
    return regions.select(_joined("chrom", dot, F.lit("region"), "start_pos", "end_pos", dot, "strand", dot, name).alias("value"))


def parse_bed(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value") != "").select(F.split("value", "\t").alias("p")).select(*_columns(F.col("p"), REGION))


def wig_lines(rows: DataFrame, bin_width: int = 1 << 18) -> DataFrame:
    """Variable-step tracks of rows (chrom, pos, level): a header before each range of positions of a chromosome."""
    placed = rows.withColumn("_b", F.floor(F.col("pos") / bin_width))
    head = placed.select("chrom", "_b").distinct().select("chrom", "_b", F.lit(0).alias("_v"), F.concat(F.lit("variableStep chrom="), "chrom").alias("value"))
    body = placed.select("chrom", "_b", F.col("pos").cast("int").alias("_v"), F.concat_ws(" ", F.col("pos").cast("string"), F.format_string("%.6f", "level")).alias("value"))
    return _in_ranges(head.unionByName(body), ["chrom", "_b"], ["chrom", "_b", "_v"])


def parse_wig(lines: DataFrame) -> DataFrame:
    """``chrom``, ``pos`` and ``level`` of variable-step tracks: each line belongs to the last header before it."""
    head = F.col("value").startswith("variableStep")
    numbered = running_total(number_lines(lines), [], "line_no", head.cast("int"), "_h", LINES)
    heads = numbered.filter(head).select(F.col("_h").alias("_n"), F.regexp_extract("value", r"chrom=(\S+)", 1).alias("chrom"))
    rows = numbered.filter(~head).select("_h", F.split("value", " ").alias("p")).join(heads, F.col("_h") == F.col("_n"))
    return rows.select("chrom", F.get("p", F.lit(0)).try_cast("int").alias("pos"), F.get("p", F.lit(1)).try_cast("double").alias("level"))


def rate_lines(rates: DataFrame, width: int) -> DataFrame:
    """Rates of distant mates per insert-size bin: its bounds and the rate."""
    lo = F.col("bin") * width
    return rates.select(F.concat_ws("\t", F.concat_ws("-", lo.cast("string"), (lo + width).cast("string")), F.col("rate").cast("string")).alias("value"))


def parse_rates(lines: DataFrame, width: int) -> DataFrame:
    p = F.split("value", "\t")
    lo = F.substring_index(F.get(p, F.lit(0)), "-", 1).try_cast("long")
    return lines.select(F.floor(lo / width).alias("bin"), F.get(p, F.lit(1)).try_cast("double").alias("rate")).filter(F.col("bin").isNotNull())


def fasta_lines(rows: DataFrame, width: int = 60) -> DataFrame:
    """Records of rows (chrom, seq), each as one value with its line ends."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return rows.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), wrapped).alias("value"))


def parse_merged(lines: DataFrame) -> DataFrame:
    """Merged haplotype files: chrom, pos, hap1, hap2, source of each position."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    return rows.select(*_columns(F.col("p"), (("chrom", "string"), ("pos", "int"), ("hap1", "string"), ("hap2", "string"), ("source", "int"))))


def parse_regions(lines: DataFrame, kind: str) -> DataFrame:
    """Annotation lines as region_id, chrom, start_pos, end_pos (1-based, inclusive) and strand. ``kind``: ``gtf``, ``gff``,
    ``bed`` (no strand), ``bed4`` (strand in the fourth column), ``ped`` (points) or ``ped3`` (points with a strand)."""
    p = F.col("p")
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    text, num = (lambda i: F.get(p, F.lit(i))), (lambda i: F.get(p, F.lit(i)).try_cast("long"))
    if kind == "gtf":
        name = F.regexp_extract(text(8), 'gene_id "([^"]*)"', 1)
        parts = (name, text(0), num(3), num(4), text(6))
    elif kind == "gff":
        parts = (F.regexp_extract(text(8), "ID=([^;]*)", 1), text(0), num(3), num(4), text(6))
    elif kind in ("bed", "bed4"):
        parts = (F.concat_ws(":", text(0), text(1)), text(0), num(1), num(2), text(3) if kind == "bed4" else F.lit("."))
    elif kind in ("ped", "ped3"):
        parts = (F.concat_ws(":", text(0), text(1)), text(0), num(1), num(1), text(2) if kind == "ped3" else F.lit("."))
    else:
        raise ValueError(f"unknown kind of regions: {kind}")
    names = ("region_id", "chrom", "start_pos", "end_pos", "strand")
    return rows.select(*[c.alias(n) for c, n in zip(parts, names)]).filter(F.col("start_pos").isNotNull())


def read_fasta(spark: SparkSession, paths: str | list[str], chunk: int = 1 << 16) -> DataFrame:
    """Sequences as chunks: chrom, chunk_start (1-based) and seq in upper case, with the two bases before and behind each
    chunk in ``before`` and ``behind``, so that contexts need no second chunk.

    Lines are numbered and placed by the lengths before them within their record, chunk by chunk.
    """
    head = F.col("value").startswith(">")
    lines = running_total(number_lines(read_lines(spark, paths)), [], "line_no", head.cast("int"), "_record", LINES)
    heads = lines.filter(head).select(F.col("_record").alias("_r"), F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"))
    rows = lines.filter(~head).join(heads, F.col("_record") == F.col("_r"))
    rows = rows.select("chrom", F.col("line_no").alias("n"), F.upper(F.trim("value")).alias("s")).withColumn("_c", F.floor(F.col("n") / 4096))
    inside = Window.partitionBy("chrom", "_c").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("chrom", "_c").agg(F.sum(F.length("s")).alias("_l"))
    before = per.select("chrom", "_c", F.coalesce(F.sum("_l").over(Window.partitionBy("chrom").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    placed = rows.withColumn("_i", F.coalesce(F.sum(F.length("s")).over(inside), F.lit(0))).join(before, ["chrom", "_c"]).withColumn("at", F.col("_b") + F.col("_i"))
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("s") - 1) / chunk)
    cut = placed.filter(F.length("s") > 0).select("chrom", "at", "s", F.explode(F.sequence(first, last)).alias("k"))
    lo, hi = F.greatest("at", F.col("k") * chunk), F.least(F.col("at") + F.length("s"), (F.col("k") + 1) * chunk)
    piece = cut.select("chrom", "k", lo.alias("lo"), F.substring("s", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    chunks = piece.groupBy("chrom", "k").agg(F.sort_array(F.collect_list(F.struct("lo", "s"))).alias("p")).select("chrom", "k", F.concat_ws("", F.col("p.s")).alias("seq"))
    w = Window.partitionBy("chrom").orderBy("k")
    edge = chunks.select("chrom", "k", F.substring("seq", -2, 2).alias("tail"), F.substring("seq", 1, 2).alias("lead"))
    edge = edge.select(F.col("chrom").alias("_ch"), F.col("k").alias("_k"), F.lag("tail", 1, "NN").over(w).alias("before"), F.lead("lead", 1, "NN").over(w).alias("behind"))
    return chunks.join(edge, (F.col("chrom") == F.col("_ch")) & (F.col("k") == F.col("_k"))).select("chrom", (F.col("k") * chunk + 1).alias("chunk_start"), "seq", "before", "behind")


def unknown_runs(chunks: DataFrame) -> DataFrame:
    """Runs of N: chrom, start_pos, end_pos; runs that go on over the border of chunks are one."""
    bare = chunks.select("chrom", "chunk_start", "seq")
    split = bare.select("chrom", "chunk_start", F.posexplode(F.regexp_extract_all("seq", F.lit("(N+|[^N]+)"), F.lit(1))).alias("i", "r"))
    at = F.coalesce(F.sum(F.length("r")).over(Window.partitionBy("chrom", "chunk_start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = split.select("chrom", (F.col("chunk_start") + at).alias("s"), F.length("r").alias("n"), F.col("r").startswith("N").alias("u")).filter("u")
    return covered_heads(runs, ["chrom"], "s", "n").select("chrom", F.col("_start").alias("start_pos"), F.col("_end").alias("end_pos"))
