"""Queries of the command-line kind: sequences of reads, quality trimming, variant filters and statistics, genotype
likelihoods, order, reference tables, and merging of phasings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import indels, merge, methcall, rangejoin
from strandweave.operators import fragments as fg
from strandweave.plans import alignments, evidence, haplotypes, states, views
from strandweave.session import cut_lineage, read_table, shared_path
from strandweave.sources import text, track

ERROR_LIMIT = 50_000  # in millionths
GAP_WINDOW = 10
LEAST_VARIANT_QUALITY = 20
CONTEXTS = ("CG", "CHG", "CHH")


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with as many qualities as bases."""
    return views.reads(spark, sf_dir, ["seq", "qual"]).filter((F.length("seq") > 0) & (F.length("seq") == F.length("qual")))


def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as they were sequenced: those aligned in reverse are turned round again, qualities too."""
    back, flag = fr.has(F.col("flag"), 0x10), F.col("flag")
    return _sequenced(spark, sf_dir).select(
        "read_id",
        F.when(fr.has(flag, 0x40), 1).when(fr.has(flag, 0x80), 2).otherwise(0).alias("mate"),
        F.when(back, fr.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of each kind and CG pairs of the reads of each chromosome."""
    s = F.upper("seq")
    n = lambda letters: F.sum(F.length(s) - F.length(F.translate(s, letters, ""))).alias(letters.lower())
    pairs = F.sum(((F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2).cast("int")).alias("cg")
    return views.reads(spark, sf_dir, ["seq"]).filter(F.length("seq") > 0).groupBy("chrom").agg(*[n(x) for x in "ACGTN"], pairs)


def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each read is kept when its ends are trimmed: the run of bases whose error rates lie furthest, in sum, below
    0.05; of equal runs the one that ends first, then the longest. 0 and 0 if no base is kept. One pass over the array."""
    q = F.transform(F.split("qual", ""), lambda c: F.lit(ERROR_LIMIT) - F.round(fr.unphred(F.ascii(c) - 33) * 1_000_000).cast("int"))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("i", "sum", "from", "best", "start", "end")])

    def step(a, x):
        total = F.when(a["sum"] < 0, x).otherwise(a["sum"] + x)
        start, i = F.when(a["sum"] < 0, a["i"]).otherwise(a["from"]), a["i"] + 1
        better = total > a["best"]
        return F.struct(
            i.alias("i"), total.alias("sum"), start.alias("from"), F.greatest(a["best"], total).alias("best"),
            F.when(better, start + 1).otherwise(a["start"]).alias("start"), F.when(better, i).otherwise(a["end"]).alias("end"),
        )

    rows = _sequenced(spark, sf_dir).select("read_id", F.aggregate(q, zero, step).alias("a"))
    return rows.select("read_id", F.col("a.start").alias("start_at"), F.col("a.end").alias("end_at"))


def _placed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = haplotypes._variants(spark, sf_dir).filter((F.length("ref_allele") > 0) & (F.length("alt_allele") > 0))
    alt = F.substring_index("alt_allele", ",", 1)
    return v.select("varid", "chrom", F.col("position").cast("long").alias("pos"), F.coalesce("qual", F.lit(-1)).alias("q"), (F.length("ref_allele") != F.length(alt)).alias("gap"))


def variant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a variant does not pass: low quality, an indel with a better one within ten bases, a substitution with an indel
    within ten bases; or ``pass``. Of equal indels the first number is the better."""
    v = _placed_variants(spark, sf_dir)
    gaps = v.filter("gap").select("chrom", (F.col("pos") - GAP_WINDOW).alias("s"), (F.col("pos") + GAP_WINDOW).alias("e"), F.col("varid").alias("other"), F.col("q").alias("oq"))
    met = rangejoin.bin_join(v, gaps, ["chrom"], "pos", "s", "e", 500).filter("other <> varid")
    beaten = ~F.col("gap") | (F.col("oq") > F.col("q")) | ((F.col("oq") == F.col("q")) & (F.col("other") < F.col("varid")))
    near = met.filter(beaten).select("varid").distinct().withColumn("_near", F.lit(True))
    why = F.when(F.col("q") < LEAST_VARIANT_QUALITY, "low_quality").when(F.col("_near").isNull(), "pass").when(F.col("gap"), "better_gap").otherwise("near_gap")
    return v.join(near, "varid", "left").select("varid", why.alias("reason"))


def substitution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions and transversions at each quality, and at it or above. Ordered are the different qualities only."""
    v = haplotypes._variants(spark, sf_dir).filter(F.col("qual").isNotNull())
    pair = F.upper(F.concat("ref_allele", F.substring_index("alt_allele", ",", 1)))
    n = v.filter(pair.rlike("^[ACGT]{2}$") & (F.substring(pair, 1, 1) != F.substring(pair, 2, 1)))
    counts = n.groupBy("qual").agg(F.count_if(pair.isin("AG", "GA", "CT", "TC")).alias("ts"), F.count_if(~pair.isin("AG", "GA", "CT", "TC")).alias("tv"))
    w = Window.orderBy(F.desc("qual"))
    return counts.select("qual", "ts", "tv", F.sum("ts").over(w).alias("ts_above"), F.sum("tv").over(w).alias("tv_above"))


def genotype_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihoods of no, one and two alternative alleles at each variant from the bases of reads, the best genotype, and
    ten times its lead over the next."""
    rows = evidence._alleles(spark, sf_dir).filter((F.col("mapq") >= alignments.MAPQ) & F.col("allele").isNotNull() & (F.col("qv") >= evidence.LEAST_BASE_QUALITY))
    e = fr.unphred(F.col("qv"))
    of = lambda a: F.round(F.sum(F.log10(F.when(F.col("allele") == a, 1 - e).otherwise(e))), 4) + 0.0
    sums = rows.groupBy("varid").agg(F.count("*").alias("n"), of(0).alias("ll0"), F.round(F.count("*") * F.log10(F.lit(0.5)), 4).alias("ll1"), of(1).alias("ll2"))
    ordered = F.sort_array(F.array("ll0", "ll1", "ll2"), asc=False)
    genotype = F.when(F.col("ll1") == ordered[0], "0/1").when(F.col("ll0") == ordered[0], "0/0").otherwise("1/1")
    return sums.select("varid", "n", "ll0", "ll1", "ll2", genotype.alias("genotype"), F.round(10 * (ordered[0] - ordered[1]), 3).alias("lead"))


def strand_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of either allele at each variant, by strand."""
    rows = evidence._alleles(spark, sf_dir)
    n = lambda c: F.count_if(c)
    return rows.groupBy("varid", "strand").agg(n(F.col("allele") == 0).alias("n_ref"), n(F.col("allele") == 1).alias("n_alt"), n(F.col("allele").isNull()).alias("n_other"))


def variant_base_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of bases that reads have at variants next to each other in the read."""
    w = Window.partitionBy("read_id").orderBy("vpos", "varid")
    rows = evidence._alleles(spark, sf_dir).select("varid", "base", F.lead("varid").over(w).alias("next_varid"), F.lead("base").over(w).alias("_b"))
    return rows.filter(F.col("next_varid").isNotNull()).groupBy("varid", "next_varid", F.concat("base", "_b").alias("pair")).agg(F.count("*").alias("n"))


def region_context_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per covered region, methylated and all calls of each context."""
    s = views.sites(spark, sf_dir).select("chrom", F.col("pos").cast("long").alias("pos"), "context", "mc", "cov")
    met = rangejoin.bin_join(s, alignments._regions(spark, sf_dir).drop("strand"), ["chrom"], "pos", "start_pos", "end_pos")
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("context") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k.lower()}")
    return met.groupBy("region_id").agg(*[of(c, k) for k in CONTEXTS for c in ("mc", "cov")])


def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in the order of coordinates: for each, how many of its chromosome begin up to and with its start."""
    rows = views.reads(spark, sf_dir).select("read_id", "chrom", "start_pos")
    return rangejoin.running_total(rows, ["chrom"], "start_pos", F.lit(1), "number", 1 << 20)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states._reference(cut_lineage(states._reads(spark, sf_dir)))


def converted_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the reference, and both conversions of it: C to T and G to A."""
    return _chunks(spark, sf_dir).select("chrom", "chunk", "seq", F.translate("seq", "C", "T").alias("c_to_t"), F.translate("seq", "G", "A").alias("g_to_a"))


def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of unknown bases in the chunks of the reference."""
    first = F.col("chunk") == 0  # position 0 is none
    start, seq = F.when(first, 1).otherwise(F.col("chunk") * methcall.CHUNK), F.when(first, F.expr("substring(seq, 2)")).otherwise(F.col("seq"))
    placed = _chunks(spark, sf_dir).select("chrom", start.alias("chunk_start"), seq.alias("seq"))
    return text.unknown_runs(placed)


def _two_phasings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of blocks phased by fragments (source 1) and of an earlier phasing by its labels (source 2)."""
    v = haplotypes._variants(spark, sf_dir).select("varid", "chrom", F.col("position").alias("pos"), "ref_allele", F.substring_index("alt_allele", ",", 1).alias("alt"), "gt", "blocks")
    new = haplotypes.chain_phase(spark, sf_dir).join(v, "varid").withColumn("source", F.lit(1))
    old = v.filter((F.col("blocks") != 0) & F.col("gt").isin("0/1", "1/0", "0|1", "1|0"))
    old = old.withColumns({"block_id": -F.col("blocks"), "hap": F.when(F.col("gt").startswith("1"), 1).otherwise(0), "source": F.lit(2)})
    columns = ["block_id", "chrom", "pos", "hap", "ref_allele", "alt", "source"]
    rows = new.select(columns).unionByName(old.select(columns))
    first, zero = F.min(F.struct("hap", "ref_allele", "alt")).alias("f"), F.col("f.hap") == 0
    one = rows.groupBy("block_id", "chrom", "pos", "source").agg(first)
    return one.select(
        "block_id", "chrom", "pos", F.when(zero, F.col("f.ref_allele")).otherwise(F.col("f.alt")).alias("hap1"), F.when(zero, F.col("f.alt")).otherwise(F.col("f.ref_allele")).alias("hap2"), "source"
    )


def merge_phasings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two phasings merged by the positions they share."""
    links = cut_lineage(_two_phasings(spark, sf_dir))
    return merge.merge_strands(links, merge.shared_votes(links))


def merge_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks merged where both ways of putting them together score clearly, by what conversion can do to a base."""
    links = cut_lineage(_two_phasings(spark, sf_dir))
    return merge.merge_strands(links, merge.weighted_votes(links))


def fragment_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per block, its variants, its edges between neighbouring calls, and its last variant."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    blocks = fg.spanning_blocks(calls)
    edges = fg.path_edges(calls).select(F.col("a").alias("varid")).groupBy("varid").agg(F.count("*").alias("_n"))
    rows = blocks.join(edges, "varid", "left")
    return rows.groupBy("block_id").agg(F.count("*").alias("n_variants"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_edges"), F.max("varid").alias("last_varid"))


def fragment_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of each library by how many usable calls they have."""
    rows = read_table(spark, sf_dir, "hapfragments").filter(F.col("frag_id").isNotNull())
    usable = F.coalesce(F.size(F.filter("alist", lambda c: c["allele"].isin("0", "1") & c["varid"].isNotNull())), F.lit(0))
    return rows.groupBy("library_id", F.greatest(usable, F.lit(0)).alias("n_calls")).agg(F.count("*").alias("n_fragments"))


def _indel_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir, ["cigar", "seq"]).select("read_id", "chrom", "start_pos", "end_pos", "cigar", "seq")


def read_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted and deleted bases that reads show, and by how many reads."""
    return indels.read_indels(_indel_reads(spark, sf_dir)).groupBy(*indels.INDEL).agg(F.count("*").alias("n_reads"))


def indel_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of them can be moved to the right."""
    return indels.right_shift(indels.read_indels(_indel_reads(spark, sf_dir)), cut_lineage(_chunks(spark, sf_dir)))


def realigned_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of them, the reads over it that hold it, that do not, and that cannot tell, and the sum of their qualities."""
    reads = cut_lineage(_indel_reads(spark, sf_dir))
    found = cut_lineage(indels.read_indels(reads))
    scored = indels.realign(found, reads, cut_lineage(_chunks(spark, sf_dir)))
    n = lambda c, name: F.count_if(c).alias(name)
    return scored.groupBy(*indels.INDEL).agg(n(F.col("allele") == 1, "n_with"), n(F.col("allele") == 0, "n_without"), n(F.col("allele").isNull(), "n_open"), F.round(F.sum("qv"), 2).alias("qv"))


def _track(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "track")
    track.write_track(views.sites(spark, sf_dir), path)
    return path


def track_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes of a written track."""
    return track.chromosomes(spark, _track(spark, sf_dir))


def track_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a written track, in runs of a million bases."""
    rows = track.read_track(spark, _track(spark, sf_dir))
    return rows.groupBy("chrom", F.floor(F.col("pos") / 1_000_000).alias("run"), "strand", "context").agg(F.count("*").alias("n"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def track_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zooms of a written track."""
    path = _track(spark, sf_dir)
    parts = [track.read_zoom(spark, path, z).select(F.lit(z).alias("zoom"), "chrom", "pos", "strand", "context", "mc", "cov", "n") for z in track.ZOOMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    f.__name__: f
    for f in (
        fastq_reads, base_composition, quality_trim, variant_filter, substitution_stats, genotype_likelihoods, strand_depth, variant_base_pairs,
        region_context_levels, read_order, converted_reference, reference_gaps, merge_phasings, merge_weighted, fragment_components, fragment_libraries,
        read_indels, indel_shifts, realigned_indels, track_chromosomes, track_values, track_zooms,
    )
}

_SEQUENCED = f"{views.READS}, sq AS (SELECT * FROM reads WHERE length(seq) > 0 AND length(seq) = length(qual))"
_PLACED = f"""{haplotypes._V}, pv AS (SELECT varid, chrom, position::BIGINT AS pos, coalesce(qual, -1) AS q, length(ref_allele) <> length(split_part(alt_allele, ',', 1)) AS gap FROM v
    WHERE length(ref_allele) > 0 AND length(alt_allele) > 0)"""
_EVIDENCE = f"ev AS (SELECT varid, allele, pow(10.0, -qv / 10.0) AS e FROM ale WHERE mapq >= {alignments.MAPQ} AND allele IS NOT NULL AND qv >= {evidence.LEAST_BASE_QUALITY})"
_CHUNKED = f"""{states._CALLED.split('cl AS (')[0].rstrip().rstrip(',')},
  cn AS (SELECT DISTINCT chrom, pos // {methcall.CHUNK} AS chunk FROM rf),
  cp AS (SELECT chrom, chunk, unnest(range(chunk * {methcall.CHUNK}, (chunk + 1) * {methcall.CHUNK})) AS pos FROM cn),
  cs AS (SELECT cp.chrom, chunk, cp.pos, coalesce(v, 'N') AS b FROM cp LEFT JOIN rf ON rf.chrom = cp.chrom AND rf.pos = cp.pos)"""
_PHASINGS = f"""{views.FRAGMENT_CALLS}, {haplotypes._EDGES}, {haplotypes._BLOCKS}, {haplotypes._CHAIN}, {haplotypes._V},
  pw AS (SELECT varid, chrom, position AS pos, ref_allele AS r, split_part(alt_allele, ',', 1) AS a, gt, blocks FROM v),
  two AS (SELECT block_id, chrom, pos, hap, r, a, 1 AS source FROM chain JOIN pw ON pw.varid = chain.varid UNION ALL
    SELECT -blocks, chrom, pos, CASE WHEN starts_with(gt, '1') THEN 1 ELSE 0 END, r, a, 2 FROM pw WHERE blocks <> 0 AND gt IN ('0/1', '1/0', '0|1', '1|0')),
  one AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY block_id, chrom, pos, source ORDER BY hap, r, a) = 1),
  links AS (SELECT block_id, chrom, pos, CASE WHEN hap = 0 THEN r ELSE a END AS hap1, CASE WHEN hap = 0 THEN a ELSE r END AS hap2, source FROM one)"""
_MERGED = """ch AS (SELECT minus_block, plus_block, score FROM votes WHERE score <> 0 QUALIFY row_number() OVER (PARTITION BY minus_block ORDER BY abs(score) DESC, plus_block) = 1),
  mv AS (SELECT coalesce(plus_block, block_id) AS block_id, chrom, pos, CASE WHEN score < 0 THEN hap2 ELSE hap1 END AS hap1, CASE WHEN score < 0 THEN hap1 ELSE hap2 END AS hap2, source
    FROM links LEFT JOIN ch ON minus_block = block_id WHERE source = 2 UNION ALL SELECT * FROM links WHERE source = 1)
  SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY block_id, chrom, pos ORDER BY source, hap1, hap2) = 1"""
_INDELS = f"""{states._CALLED.split('cl AS (')[0].rstrip().rstrip(',')},
  ix AS (SELECT read_id, chrom, start_pos, seq, unnest(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDSN]', 1), lambda x: x::INT)) AS len, unnest(regexp_extract_all(cigar, '[0-9]+([MIDSN])', 1)) AS op,
      generate_subscripts(regexp_extract_all(cigar, '[0-9]+([MIDSN])', 1), 1) AS k FROM reads WHERE seq IS NOT NULL),
  iy AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0)::INT AS r, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w, 0)::INT AS g
    FROM ix WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ind AS (SELECT read_id, chrom, start_pos + g AS pos, CASE op WHEN 'D' THEN len ELSE 0 END AS n_deleted, CASE op WHEN 'D' THEN '' ELSE upper(seq[r + 1 : r + len]) END AS inserted
    FROM iy WHERE op IN ('I', 'D') AND g > 0 AND len > 0)"""
_MEET = "links p JOIN links m ON p.source = 1 AND m.source = 2 AND p.chrom = m.chrom AND"


def _score(letters: str) -> str:
    a, b, c, d = letters
    named = " ".join(f"WHEN '{k}' THEN {s}" for k, s in merge.SHARED_SCORES.items())
    return f"CASE WHEN {a} = {b} AND {c} = {d} THEN {merge.AGREE} ELSE CASE {a} || {b} || {c} || {d} {named} ELSE -{merge.AGREE} END END"


def _cpg(letters: str) -> str:
    return f"CASE WHEN {letters} IN {merge.CPG_SCORES} THEN {merge.AGREE_CPG} ELSE -{merge.AGREE_CPG} END"


_KEPT, _SWAPPED = ("p.hap1", "m.hap1", "p.hap2", "m.hap2"), ("p.hap1", "m.hap2", "p.hap2", "m.hap1")

SQL = {
    "fastq_reads": f"""WITH {_SEQUENCED} SELECT read_id, CASE WHEN flag & 64 = 64 THEN 1 WHEN flag & 128 = 128 THEN 2 ELSE 0 END AS mate,
      CASE WHEN flag & 16 = 16 THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END AS seq, CASE WHEN flag & 16 = 16 THEN reverse(qual) ELSE qual END AS qual FROM sq""",
    "base_composition": f"""WITH {views.READS}, s AS (SELECT chrom, upper(seq) AS s FROM reads WHERE length(seq) > 0)
      SELECT chrom, {', '.join(f"sum(length(s) - length(replace(s, '{x}', '')))::BIGINT AS {x.lower()}" for x in 'ACGTN')}, (sum(length(s) - length(replace(s, 'CG', ''))) // 2)::BIGINT AS cg FROM s GROUP BY chrom""",
    "quality_trim": f"""WITH {_SEQUENCED}, c AS (SELECT read_id, qual, unnest(range(length(qual))) AS j FROM sq),
      d AS (SELECT read_id, j, sum({ERROR_LIMIT} - round(pow(10.0, -(ascii(qual[j + 1]) - 33) / 10.0) * 1000000)::INT) OVER (PARTITION BY read_id ORDER BY j) AS t FROM c),
      m AS (SELECT *, least(0, coalesce(min(t) OVER (PARTITION BY read_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo FROM d),
      l AS (SELECT read_id, list(t ORDER BY j) AS t, list(lo ORDER BY j) AS lo, list(t - lo ORDER BY j) AS g FROM m GROUP BY read_id), b AS (SELECT *, list_position(g, list_max(g)) AS e FROM l)
      SELECT read_id, CASE WHEN g[e] <= 0 THEN 0 WHEN lo[e] = 0 THEN 1 ELSE list_position(t, lo[e]) + 1 END::INT AS start_at, CASE WHEN g[e] > 0 THEN e ELSE 0 END::INT AS end_at FROM b""",
    "variant_filter": f"""WITH {_PLACED} SELECT varid, CASE WHEN q < {LEAST_VARIANT_QUALITY} THEN 'low_quality' WHEN NOT EXISTS (SELECT 1 FROM pv o WHERE o.gap AND o.chrom = x.chrom AND o.varid <> x.varid
        AND x.pos BETWEEN o.pos - {GAP_WINDOW} AND o.pos + {GAP_WINDOW} AND (NOT x.gap OR o.q > x.q OR (o.q = x.q AND o.varid < x.varid))) THEN 'pass' WHEN gap THEN 'better_gap' ELSE 'near_gap' END AS reason FROM pv x""",
    "substitution_stats": f"""WITH {haplotypes._V}, p AS (SELECT qual, upper(ref_allele || split_part(alt_allele, ',', 1)) AS p FROM v WHERE qual IS NOT NULL),
      c AS (SELECT qual, count(*) FILTER (p IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (p NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM p WHERE regexp_full_match(p, '[ACGT]{{2}}') AND p[1] <> p[2] GROUP BY qual)
      SELECT qual, ts, tv, sum(ts) OVER w::BIGINT AS ts_above, sum(tv) OVER w::BIGINT AS tv_above FROM c WINDOW w AS (ORDER BY qual DESC)""",
    "genotype_likelihoods": f"""WITH {evidence._ALLELES}, {_EVIDENCE}, s AS (SELECT varid, count(*) AS n, round(sum(log10(CASE WHEN allele = 0 THEN 1 - e ELSE e END)), 4) + 0.0 AS ll0,
        round(count(*) * log10(0.5), 4) AS ll1, round(sum(log10(CASE WHEN allele = 1 THEN 1 - e ELSE e END)), 4) + 0.0 AS ll2 FROM ev GROUP BY varid), o AS (SELECT *, list_reverse_sort([ll0, ll1, ll2]) AS o FROM s)
      SELECT varid, n, ll0, ll1, ll2, CASE WHEN ll1 = o[1] THEN '0/1' WHEN ll0 = o[1] THEN '0/0' ELSE '1/1' END AS genotype, round(10 * (o[1] - o[2]), 3) AS lead FROM o""",
    "strand_depth": f"""WITH {evidence._ALLELES} SELECT varid, strand, count(*) FILTER (allele = 0) AS n_ref, count(*) FILTER (allele = 1) AS n_alt, count(*) FILTER (allele IS NULL) AS n_other FROM ale GROUP BY ALL""",
    "variant_base_pairs": f"""WITH {evidence._ALLELES}, n AS (SELECT varid, base, lead(varid) OVER w AS next_varid, lead(base) OVER w AS b FROM ale WINDOW w AS (PARTITION BY read_id ORDER BY vpos, varid))
      SELECT varid, next_varid, base || b AS pair, count(*) AS n FROM n WHERE next_varid IS NOT NULL GROUP BY ALL""",
    "region_context_levels": f"""WITH {alignments._BINNED.split('met AS')[0].rstrip().rstrip(',')}, {views.SITES}
      SELECT region_id, {', '.join(f"coalesce(sum({c}) FILTER (context = '{k}'), 0)::BIGINT AS {c}_{k.lower()}" for k in CONTEXTS for c in ('mc', 'cov'))}
      FROM sites s JOIN regions g ON g.chrom = s.chrom AND s.pos BETWEEN g.start_pos AND g.end_pos GROUP BY region_id""",
    "read_order": f"WITH {views.READS} SELECT read_id, chrom, start_pos, count(*) OVER (PARTITION BY chrom ORDER BY start_pos) AS number FROM reads",
    "converted_reference": f"""WITH {_CHUNKED}, s AS (SELECT chrom, chunk, string_agg(b, '' ORDER BY pos) AS seq FROM cs GROUP BY ALL)
      SELECT chrom, chunk, seq, translate(seq, 'C', 'T') AS c_to_t, translate(seq, 'G', 'A') AS g_to_a FROM s""",
    "reference_gaps": f"""WITH {_CHUNKED}, n AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS r FROM cs WHERE b = 'N' AND pos > 0)
      SELECT chrom, min(pos) AS start_pos, max(pos) AS end_pos FROM n GROUP BY chrom, r""",
    "merge_phasings": f"""WITH {_PHASINGS}, x AS (SELECT p.block_id AS plus_block, m.block_id AS minus_block, CASE WHEN p.hap1 = m.hap1 AND p.hap2 = m.hap2 THEN {merge.WEIGHT}
          WHEN p.hap1 = m.hap2 AND p.hap2 = m.hap1 THEN -{merge.WEIGHT} END AS s FROM {_MEET} p.pos = m.pos),
      votes AS (SELECT plus_block, minus_block, sum(s) AS score FROM x WHERE s IS NOT NULL GROUP BY ALL), {_MERGED}""",
    "merge_weighted": f"""WITH {_PHASINGS}, x AS (SELECT p.block_id AS plus_block, m.block_id AS minus_block, {_score(_KEPT)} AS k, {_score(_SWAPPED)} AS s FROM {_MEET} p.pos = m.pos UNION ALL
        SELECT p.block_id, m.block_id, {_cpg(' || '.join(_KEPT))}, {_cpg(' || '.join(_SWAPPED))} FROM {_MEET} p.pos + 1 = m.pos WHERE p.hap1 IN ('C', 'T') AND p.hap2 IN ('C', 'T')),
      y AS (SELECT plus_block, minus_block, sum(k) AS k, sum(s) AS s FROM x GROUP BY ALL),
      votes AS (SELECT plus_block, minus_block, CASE WHEN greatest(k, s) >= {merge.LEAST_SCORE} AND least(k, s) <= -{merge.LEAST_SCORE} THEN k - s ELSE 0 END AS score FROM y), {_MERGED}""",
    "fragment_components": f"""WITH {views.FRAGMENT_CALLS}, {haplotypes._EDGES}, {haplotypes._BLOCKS}, e AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
      SELECT block_id, count(*) AS n_variants, coalesce(sum(n), 0)::BIGINT AS n_edges, max(varid) AS last_varid FROM blocks LEFT JOIN e ON a = varid GROUP BY block_id""",
    "read_indels": f"WITH {_INDELS} SELECT chrom, pos, n_deleted, inserted, count(*) AS n_reads FROM ind GROUP BY ALL",
    "indel_shifts": f"""WITH {_INDELS}, u AS (SELECT DISTINCT chrom, pos, n_deleted, inserted FROM ind), i AS (SELECT *, unnest(range(4000)) AS i FROM u),
      c AS (SELECT i.*, a.v AS ref, CASE WHEN n_deleted > 0 OR i >= length(inserted) THEN b.v ELSE inserted[i + 1] END AS moved FROM i LEFT JOIN rf a ON a.chrom = i.chrom AND a.pos = i.pos + i
        LEFT JOIN rf b ON b.chrom = i.chrom AND b.pos = i.pos + i + n_deleted - length(inserted))
      SELECT chrom, pos, n_deleted, inserted, min(i) AS shift FROM c WHERE ref IS NULL OR moved IS NULL OR ref <> moved GROUP BY ALL""",
    "track_chromosomes": f"WITH {views.SITES} SELECT chrom, count(*) AS n, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM sites GROUP BY chrom",
    "track_values": f"""WITH {views.SITES} SELECT chrom, (pos // 1000000)::BIGINT AS run, strand, context, count(*) AS n, sum(mc)::BIGINT AS mc, sum(cov)::BIGINT AS cov FROM sites GROUP BY ALL""",
    "track_zooms": f"""WITH {views.SITES}, z AS (SELECT unnest({list(track.ZOOMS)}) AS zoom) SELECT zoom, chrom, (pos // zoom * zoom)::BIGINT AS pos, strand, context,
      sum(mc)::BIGINT AS mc, sum(cov)::BIGINT AS cov, count(*) AS n FROM sites, z GROUP BY ALL""",
    "fragment_libraries": """SELECT library_id, coalesce(len(list_filter(alist, lambda c: c.allele IN ('0', '1') AND c.varid IS NOT NULL)), 0)::INT AS n_calls, count(*) AS n_fragments
      FROM hapfragments WHERE frag_id IS NOT NULL GROUP BY ALL""",
}
