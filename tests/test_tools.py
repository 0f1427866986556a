"""Queries that hardly meet rows in the given tables, against their SQL on reads laid over variants; tracks; scored merging."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandweave.operators import merge
from strandweave.plans import catalogue
from strandweave.sources import track
from tests.test_queries import norm


@pytest.fixture(scope="module")
def dense(sf_dir, tmp_path_factory):
    """Tables of the given columns, with reads over a hundred variants of three hundred bases."""
    rnd, folder = random.Random(8), tmp_path_factory.mktemp("dense")
    reads, variants = pq.read_table(f"{sf_dir}/alignedread.parquet"), pq.read_table(f"{sf_dir}/readvariant.parquet")
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rows = reads.slice(0, 300).to_pylist()
    for i, r in enumerate(rows):
        n = rnd.randint(10, 60)
        r |= {
            "read_id": f"r{i // 2 if i < 20 else i}", "chrom": rnd.choice(["chr1", "chr1", "chr2", None]), "position": rnd.randint(1, 280), "span": n, "mapq": rnd.choice([0, 30, 60, None]),
            "seq": rnd.choice([word(n), None, ""]) if i % 10 == 0 else word(n), "cigar": rnd.choice([f"{n}M", f"5M2D{n - 5}M", f"3S{n - 3}M"]), "qual": "".join(rnd.choice("!#+5FI") for _ in range(n)), "meth_state": "=" * n,
        }
    calls = variants.slice(0, 100).to_pylist()
    for i, r in enumerate(calls):
        r |= {"varid": i + 1, "chrom": rnd.choice(["chr1", "chr2", None]), "position": rnd.randint(1, 300), "ref_allele": rnd.choice(["A", "C", "AT", None]), "alt_allele": rnd.choice(["G", "T", "TT", "G,A", None]), "qual": rnd.choice([10, 20, 30, None])}
    pq.write_table(pa.Table.from_pylist(rows, reads.schema), f"{folder}/alignedread.parquet")
    pq.write_table(pa.Table.from_pylist(calls, variants.schema), f"{folder}/readvariant.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name", ["genotype_likelihoods", "strand_depth", "variant_base_pairs", "variant_filter", "substitution_stats", "quality_trim", "fastq_reads", "base_composition", "read_order", "read_fragments"]
)
def test_dense(spark, dense, name):
    con = duckdb.connect()
    for t in ("alignedread", "readvariant"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{dense}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, dense)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert len(got) > 1


LINKS = "block_id long, chrom string, pos int, hap1 string, hap2 string, source int"


def test_scored_merging(spark):
    rows = [
        (1, "c", 10, "C", "T", 1), (1, "c", 20, "A", "G", 1), (1, "c", 30, "T", "C", 1),
        (11, "c", 11, "A", "G", 2), (11, "c", 20, "G", "A", 2),  # both say: swapped
        (2, "c", 100, "C", "T", 1), (2, "c", 120, "A", "G", 1),
        (12, "c", 101, "A", "G", 2), (12, "c", 120, "A", "G", 2), (12, "c", 200, "T", None, 2),  # four against, six for
        (13, "c", 300, "C", "T", 2),
        (14, None, None, None, None, 2),
    ]
    links = spark.createDataFrame(rows, LINKS)
    votes = {r.minus_block: (r.kept, r.swapped, r.score) for r in merge.weighted_votes(links).collect()}
    assert votes == {11: (-10, 10, -20), 12: (2, -2, 4)}
    out = {(r.chrom, r.pos): (r.block_id, r.hap1, r.hap2) for r in merge.merge_strands(links, merge.weighted_votes(links)).collect()}
    assert out["c", 11] == (1, "G", "A") and out["c", 101] == (2, "A", "G") and out["c", 300] == (13, "C", "T")
    shared = {r.minus_block: r.score for r in merge.shared_votes(links).collect()}
    assert shared == {11: -2, 12: 2}
    none = links.limit(0)
    assert merge.merge_strands(none, merge.weighted_votes(none)).collect() == []


def test_converted_bases_score(spark):
    pairs = [("T", "C", "T", "T", 0), ("T", "C", "A", "A", 6), ("G", "A", "T", "C", 4), ("C", "C", "C", "C", 6), ("A", "C", "G", "T", -6)]
    df = spark.createDataFrame(pairs, "a string, b string, c string, d string, want int")
    got = df.select("want", merge._shared_score(F.concat("a", "b", "c", "d")).alias("s")).collect()
    assert all(r.s == r.want for r in got)


def test_track(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "a", "b"]), rnd.randint(1, 5000), rnd.choice("+-"), "CG", rnd.randint(0, 9), 9, "more") for _ in range(400)] + [(None, 5, "+", "CG", 1, 2, ""), ("a", None, "+", "CG", 1, 2, "")]
    path = str(tmp_path / "t")
    track.write_track(spark.createDataFrame(rows, "chrom string, pos int, strand string, context string, mc int, cov int, extra string"), path, (100, 1000))
    part = track.read_track(spark, path, "a", 100, 2000)
    assert sorted(tuple(r) for r in part.collect()) == sorted(r[:6] for r in rows if r[0] == "a" and r[1] is not None and 100 <= r[1] <= 2000)
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pos,100)" in plan and "EqualTo(chrom,a)" in plan
    assert track.read_zoom(spark, path, 1000).agg(F.sum("n"), F.sum("cov")).first()[:] == (400, 3600)
    assert {r.chrom: r.n for r in track.chromosomes(spark, path).collect()} == {c: sum(r[0] == c and r[1] is not None for r in rows) for c in "ab"}
    empty = str(tmp_path / "e")
    track.write_track(spark.createDataFrame([], "chrom string, pos int, strand string, context string, mc int, cov int"), empty)
    assert track.read_track(spark, empty).collect() == [] and track.read_zoom(spark, empty, 1000).collect() == []
