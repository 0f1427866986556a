import gzip

import pytest
from pyspark.sql import functions as F

from strandweave.operators import fragments as fg, sites
from strandweave.sources import text
from strandweave.streaming import windows


def write(tmp_path, name, body):
    p = tmp_path / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(body.encode()))
    else:
        p.write_text(body)
    return str(p)


METH = "#chrom\tpos\nc1\t50\t-\tCHG\t2\t4\t0.5\tnull\t3\t3\tU\tTACTG\nc1\t60\t+\tCG\t0\t5\t0\t4.5\t4\t4\tU\tCTCTA\n\n"


@pytest.mark.parametrize("name", ["x.mr", "x.mr.gz"])
def test_ratio_file_to_variants(spark, tmp_path, name):
    rows = text.parse_methratio(text.read_lines(spark, write(tmp_path, name, METH)))
    assert [(r.pos, r.methlevel, r.eff_ct) for r in rows.orderBy("pos").collect()] == [(50, 0.5, None), (60, 0.0, 4.5)]
    found = sites.heterozygous(rows.select("chrom", "pos", "strand", F.col("c_count").alias("mc"), F.col("coverage").alias("cov")), least_cov=4, both_alleles=False)
    v = sites.pseudo_variants(found).first()
    assert (v.pos, v.ref, v.alt, v.gt) == (50, "G", "A", "0/1")


def test_sam(spark, tmp_path):
    body = "@HD\tVN:1\nr1\t99\tc\t7\t60\t5M\t=\t90\t88\tACGTA\tFFFFF\tXX:Z:a\tNM:i:2\tMD:Z:==Z=h\nr2\t4\t*\tx\t0\t*\t*\t0\t0\t*\t*\n"
    got = text.parse_sam(text.read_lines(spark, write(tmp_path, "x.sam", body))).orderBy("read_id").collect()
    assert (got[0].position, got[0].nm, got[0].meth_state) == (7, 2, "==Z=h")
    assert (got[1].position, got[1].nm, got[1].meth_state) == (None, None, None)


def test_vcf_takes_genotype_by_its_place(spark, tmp_path):
    body = "##x\n#CHROM\nc\t5\t.\tA\tG\t30\tPASS\t.\tDP:GT\t9:0/1\nc\t6\t.\tA\tG\t30\tq\t.\tDP\t9\n"
    got = text.parse_vcf(text.read_lines(spark, write(tmp_path, "x.vcf", body))).orderBy("position").collect()
    assert [r.gt for r in got] == ["0/1", None]


def test_fragment_lines_of_both_forms(spark):
    lines = ["2 f1 3 01 9 1 ?I+", "1 f2 0 -1 -1 2 11 55", "0 f3", "1 f4 2 0", "x"]
    got = text.parse_fragments(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.frag_id, r.varid, r.allele, r.qv, r.dtype) for r in got] == [
        ("f1", 3, 0, 30, None), ("f1", 4, 1, 40, None), ("f1", 9, 1, 10, None), ("f2", 2, 1, 20, 0), ("f2", 3, 1, 20, 0),
    ]


def test_block_file_round_trip(spark, tmp_path):
    rows = [(b, v, v % 2, "c", 10 * v, "C", "T", "0/1", 99.5) for b, vs in ((1, (1, 2, 3)), (7, (7, 9))) for v in vs]
    df = spark.createDataFrame(rows, "block_id long, varid long, hap int, chrom string, pos int, ref string, alt string, gt string, mismatch_q double")
    path = str(tmp_path / "blocks")
    text.block_lines(df).coalesce(1).write.text(path)
    lines = [r.value for r in text.read_lines(spark, path).collect()]
    assert lines[0] == "BLOCK: offset: 1 len: 3 phased: 3 SPAN: 20" and lines.count(text.SEPARATOR) == 2
    got = sorted((r.block, r.varid, r.hap1, r.mismatch_q) for r in text.parse_blocks(text.read_lines(spark, path)).collect())
    assert got == [(1, 1, "1", 99.5), (1, 2, "0", 99.5), (1, 3, "1", 99.5), (2, 7, "1", 99.5), (2, 9, "1", 99.5)]


@pytest.mark.parametrize("kind,line,want", [
    ("bed", "c\t5\t9", ("c:5", "c", 5, 9, ".")),
    ("bed4", "c\t5\t9\t-", ("c:5", "c", 5, 9, "-")),
    ("ped", "c\t5", ("c:5", "c", 5, 5, ".")),
    ("ped3", "c\t5\t+", ("c:5", "c", 5, 5, "+")),
    ("gff", "c\ts\tgene\t5\t9\t.\t-\t.\tID=g1;x=y", ("g1", "c", 5, 9, "-")),
    ("gtf", 'c\ts\tgene\t5\t9\t.\t+\t.\tgene_id "g2"; x "y"', ("g2", "c", 5, 9, "+")),
])
def test_regions(spark, kind, line, want):
    df = spark.createDataFrame([("# head",), (line,), ("",)], "value string")
    assert [tuple(r) for r in text.parse_regions(df, kind).collect()] == [want]


def test_unknown_kind_of_regions(spark):
    with pytest.raises(ValueError):
        text.parse_regions(spark.createDataFrame([("x",)], "value string"), "xyz")


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_fasta(spark, tmp_path, chunk):
    body = ">c1 first\nACGNN\nnnACG\n\nT\n>c2\nNNNN\n>c3\nacgt\n"
    chunks = text.read_fasta(spark, write(tmp_path, "x.fa", body), chunk)
    seqs = {}
    for r in chunks.orderBy("chunk_start").collect():
        assert r.chunk_start == len(seqs.get(r.chrom, "")) + 1
        seqs[r.chrom] = seqs.get(r.chrom, "") + r.seq
    assert seqs == {"c1": "ACGNNNNACGT", "c2": "NNNN", "c3": "ACGT"}
    assert sorted(tuple(r) for r in text.unknown_runs(chunks).collect()) == [("c1", 4, 7), ("c2", 1, 4)]


def test_line_numbers_over_splits(spark):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "value string").repartitionByRange(5, F.col("value").cast("int"))
    assert all(int(r.value) + 1 == r.line_no for r in text.number_lines(df).collect())


def test_runs_through_the_fragment_form(spark):
    calls = spark.createDataFrame([("a", 1, 0, 30), ("a", 2, 1, 93), ("a", 6, 1, 0)], "frag_id string, varid long, allele int, qv int")
    back = text.parse_fragments(text.fragment_lines(fg.fragment_runs(calls))).select("frag_id", "varid", "allele", "qv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, calls.collect()))


def test_late_rows_are_dropped_and_mates_meet(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "at timestamp, k string, v double"

    def add(*rows):
        spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "at string, k string, v double").select(F.to_timestamp("at").alias("at"), "k", "v").coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(schema).parquet(path)

    add(("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:40:00", "b"))
    query = windows.windowed_counts(stream(), "at", "k", "v", "1 minute").writeStream.format("memory").queryName("w").outputMode("append").start()
    query.processAllAvailable()
    add(("2024-01-01 00:00:20", "a"), ("2024-01-01 02:00:00", "b"))  # the first is too late
    query.processAllAvailable()
    query.stop()
    got = {(r.k, r.n) for r in spark.sql("SELECT * FROM w").collect()}
    assert ("a", 2) in got and ("a", 3) not in got
    pairs = windows.paired_mates(stream().select("at", "k"), stream().select("at", "k"), "k", "at", "1 minute")
    query = pairs.writeStream.format("memory").queryName("m").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("m").filter("k = 'a'").count() >= 4


def test_a_table_of_a_stream_has_no_late_and_no_repeated_rows(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "run")

    def run(*rows):
        df = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "at string, k string, v double")
        df.select(F.to_timestamp("at").alias("at"), "k", "v").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("at timestamp, k string, v double").parquet(path)
        out = windows.run_to_table(windows.windowed_counts(stream, "at", "k", "v", "1 minute"), base)
        return sorted((str(r.start_at)[11:16], r.k, r.n) for r in out.collect())

    assert run(("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:40:00", "b")) == [("00:00", "a", 2)]
    late = run(("2024-01-01 00:00:20", "a"), ("2024-01-01 00:40:30", "b"), ("2024-01-01 02:00:00", "b"))
    assert late == [("00:00", "a", 2), ("00:40", "b", 2)]


def test_lines_are_numbered_in_the_order_of_files_and_places(spark, tmp_path):
    for name, n in (("b", 500), ("a", 3), ("c", 40)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:04d}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        rows = text.number_lines(text.read_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{name}{i:04d}" for name, n in (("a", 3), ("b", 500), ("c", 40)) for i in range(n)]
    assert [r.value for r in sorted(rows, key=lambda r: r.line_no)] == want and [r.line_no for r in sorted(rows, key=lambda r: r.line_no)] == list(range(1, 544))


def test_pair_files_break_where_pairs_do_not_follow(spark, tmp_path):
    rows = [("c", "+", a, b, 1, 0, 0, 2, 0.5) for a, b in ((1, 4), (4, 9), (11, 15), (15, 300_000), (300_000, 300_004), (300_009, 300_010))] + [("c", "-", 1, 4, 1, 0, 0, 2, None)]
    df = spark.createDataFrame(rows, "chrom string, strand string, c1 long, c2 long, mm long, mu long, um long, uu long, p double")
    path = str(tmp_path / "pairs")
    text.write_lines(text.pair_lines(df), path)
    lines = [r.value for r in sorted(text.number_lines(text.read_lines(spark, path)).collect(), key=lambda r: r.line_no)]
    assert [(x.split("\t") + [""] * 3)[2] for x in lines if "\t-" not in x] == ["1", "4", "", "11", "15", "300000", "", "300009"]
    assert sorted(map(str, text.parse_pairs(text.read_lines(spark, path)).collect())) == sorted(map(str, df.collect()))


def test_tracks_keep_their_chromosomes(spark, tmp_path):
    df = spark.createDataFrame([(c, p, p % 7 / 7) for c in ("c", "d") for p in (1, 5, 299_999, 300_000, 900_000)], "chrom string, pos int, level double")
    path = str(tmp_path / "wig")
    text.write_lines(text.wig_lines(df), path)
    got = {(r.chrom, r.pos): r.level for r in text.parse_wig(text.read_lines(spark, path)).collect()}
    assert got == {(r.chrom, r.pos): round(r.level, 6) for r in df.collect()}
