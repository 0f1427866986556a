import math

from pyspark.sql import functions as F

from strandweave.operators import skew


def test_weighted_results_equal_plain_ones(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919) % 3001).alias("v"),
    )
    freq = skew.value_frequencies(df, "k", "v")
    rows = df.filter("k is not null").collect()
    got = {r.key: r for r in skew.summarize_keys(freq).collect()}
    medians = {r.key: r.value for r in skew.weighted_percentiles(freq, [0.5], bucket=100).collect()}
    assert set(got) == {r.k for r in rows}
    for k, r in got.items():
        values = sorted(x.v for x in rows if x.k == k and x.v is not None)
        assert (r.n_rows, r.n_values, r.total) == (sum(x.k == k for x in rows), len(set(values)), sum(values))
        best = max(values.count(v) for v in set(values))
        assert r["mode"] == min(v for v in set(values) if values.count(v) == best)
        assert medians[k] == values[-(-len(values) // 2) - 1]


def test_heavy_keys_count_null_rows_among_all(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)] * 4 + [(None, 1)] * 91, "k string, v long")
    got = skew.heavy_keys(skew.value_frequencies(df, "k", "v"), 0.05).collect()
    assert [(r.key, r.n_rows) for r in got] == [("a", 5)]


def test_empty_and_all_null_values(spark):
    df = spark.createDataFrame([], "k string, v long")
    freq = skew.value_frequencies(df, "k", "v")
    assert skew.summarize_keys(freq).count() == skew.heavy_keys(freq, 0.05).count() == 0
    one = skew.summarize_keys(skew.value_frequencies(spark.createDataFrame([("a", None)], "k string, v long"), "k", "v")).first()
    assert (one.n_rows, one.n_values, one.total, one["mode"]) == (1, 0, None, None)


def test_percentiles_of_fractions(spark):
    values = [i / 977 for i in range(-300, 700)] + [1e-300, -1e300, 5.0, 0.0, float("nan")]
    df = spark.createDataFrame([("a", v) for v in values for _ in range(2)] + [("a", None)], "k string, v double")
    known = sorted(v for v in values if v == v)
    got = {r.point: r.value for r in skew.weighted_percentiles(skew.value_frequencies(df, "k", "v"), [0.1, 0.5, 0.999], bucket=16).collect()}
    twice = [v for v in known for _ in range(2)]
    assert got == {p: twice[math.ceil(p * len(twice)) - 1] for p in (0.1, 0.5, 0.999)}
