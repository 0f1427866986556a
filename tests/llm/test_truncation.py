import pytest
from pyspark.sql import functions as F

from strandweave.llm import truncation as t

FULL = "COURT OF X\n\n1. The first claim was heard at length. It was dismissed.\n\n2. The second claim was bound by the terms of the lease, at the site in Dorvan. The guarantee was withdrawn in part."
DOCS = {
    1: FULL,
    2: FULL + "\n\n- end of judgment -",
    3: FULL[:-20],  # within a word or sentence
    4: FULL[: FULL.index(" The guarantee")],  # complete, though shorter
    5: FULL + "\n\nCertified copy, seal of the court",
    6: FULL + "\n\n3. The third claim was bo",
    7: FULL + "\n\n3. The third claim was dis...",
    8: FULL + "\n\n3. The third claim was dis�",
    9: FULL + "\n\n3. The consent of X....",
    10: None,
    11: "",
    12: " \n\t ",
    13: FULL + "\r\n\r\nPage 3 of 3  ",
    14: FULL[:-20],
    15: FULL + "\n\n[3] The third claim was heard at length, at the site in Dorvan",
    16: FULL + " He said: «The guarantee was withdrawn.» ",
    17: "1. " + "The second claim was bound by the terms of the lease, " * 3000 + "The guarantee was wi",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "s%d" % (i % 2), 0) for i, x in DOCS.items()], "doc_id long, text string, source string, evidence int").repartition(3)


@pytest.mark.parametrize("most_keys", [200_000, 3, 0])
def test_cut_texts(docs, most_keys):
    got = {r.doc_id: r.evidence for r in t.truncated_texts(docs, most_keys=most_keys).collect()}
    assert set(got) == {3, 6, 7, 8, 14, 15, 17}


def test_strict_prefixes_against_brute_force(spark):
    values = ["abc", "abcdefgh", "abcdefgh", "abd", "x", "", None, "zzzzzzzzzzzzzzzz", "ééééé", "zzzz", "zzzzz"]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    c = spark.createDataFrame([(i, x) for i, x in enumerate([*values, "ab", "éé", "q"])], "id int, value string")
    want = {r.id for r in c.collect() if r.value and any(x and x != r.value and x.startswith(r.value) for x in values)}
    for most_keys in (100, 1, 0):
        assert {r.id for r in t.strict_prefixes(c, v, most_keys).collect()} == want


def test_whole_texts_cut_from_longer_copies_are_seen_as_such(spark):
    base = "1. " + " ".join(f"word{i} claims the lease, and" for i in range(200))
    df = spark.createDataFrame([(1, base + " so ends."), (2, base[:2000]), (3, base[:2000])], "doc_id long, text string")
    assert {r.doc_id: r.evidence for r in t.truncated_texts(df).collect()} == {2: "document", 3: "document"}


def test_sources(docs):
    got = {r.source: r for r in t.truncation_by_source(docs).collect()}
    assert (got["s0"].n_texts, got["s0"].n_cut) == (6, 3) and (got["s1"].n_texts, got["s1"].n_cut) == (8, 4)
    assert got["s1"].cut_share == pytest.approx(0.5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert t.truncated_texts(df).count() == t.truncation_by_source(df).count() == 0
    assert t.open_tails(df.withColumn("last", F.lit(1)), "doc_id", "text").count() == 0


def test_repeated_and_null_keys(spark):
    text = "1. The first claim was heard, and the second claim was dis"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "missed.")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in t.truncated_texts(df).collect()) == ["1", "None"]


def test_an_open_end_decides_where_no_longer_copy_is(spark):
    rows = [
        (1, "1. The claim was heard. So far as Tastasal"),  # a last word that is nowhere else
        (2, "1. The cat sat on the lease. It bound a cat"),  # used elsewhere, but nowhere continued
        (3, "1. Heard by the boa"),
        (4, "1. Heard by the board of the town. The board sat."),
        (5, "1. The claim was seen by the gua"),
        (6, "1. The guarantee was withdrawn."),
    ]
    got = {r.doc_id: r.evidence for r in t.truncated_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ending", 2: "ending", 3: "document", 5: "ending"}


def test_prefixes_of_all_lengths_against_brute_force(spark):
    base = "".join(chr(97 + i * i % 26) for i in range(70))
    values = [base[:i] for i in (1, 2, 3, 7, 8, 9, 31, 33, 64, 70)] + [base[:20] + "\nmore", base[:21] + " \t\n", base[:5] + "#", "", None]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    c = spark.createDataFrame(list(enumerate([base[:i] for i in range(1, 71)] + [base[:20] + "\nmo"])), "id int, value string")
    goes_on = lambda x, r: x.startswith(r) and x[len(r) :].split("\n")[0].strip() != ""
    want = {r.id for r in c.collect() if any(x and goes_on(x, r.value) for x in values)}
    for most_keys in (100, 1):
        assert {r.id for r in t.strict_prefixes(c, v, most_keys).collect()} == want


def test_a_cut_text_with_a_longer_copy_needs_no_numbered_paragraph(spark):
    base = " ".join(f"the lessor of plot {i} claims its rent and" for i in range(30)) + " so it ends."
    rows = [
        (1, base), (2, base[:400]), (3, base[: base.index(" claims")]), (4, base[:401] + "\n\n(Signed) The Registrar"),
        (5, "Minutes\nThe board sat at noon"), (6, "Minutes\nThe board sat at noon\nAnnexes follow"), (7, base + " What follows"), (8, base[:47] + "..."),
        (9, "Elsewhere\n" + base), (10, "Elsewhere again\n" + base[:300]),
    ]
    got = {r.doc_id: r.evidence for r in t.truncated_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: "document", 3: "document", 8: "document", 10: "line"}


WRAPPED = "COURT OF X\n\n1. The first claim was heard at length, and it was dis-\nmissed with costs.\n\n2. The second claim was bound by the terms\nof the lease, at the site in Dor-\nvan. The guarantee was "


def test_cuts_on_wrapped_lines(spark):
    rows = [
        (1, WRAPPED + "with"),
        (2, WRAPPED + "withdrawn\nin part."),
        (3, WRAPPED + "withdrawn\nin part.\n(Signed) The Registrar"),
        (4, WRAPPED + "withdrawn\nin part.\n\nDone at Dorvan on 3 May 1990\nPage 3 of 3"),
        (5, (WRAPPED + "withdrawn\nin pa").replace("\n", "\r\n")),
        (6, WRAPPED.replace(" The guarantee was ", "\nThe guarantee was withdrawn without the con")),
        (7, WRAPPED + "kept\n- end of judgment -"),  # complete, though it lacks its full stop
        (8, WRAPPED + "kept"),
        (9, "1. The claim was heard.\n\n2. It was dismissed.\nNotice to all parties"),
        (10, WRAPPED[: WRAPPED.index(" The guarantee")] + "\nPage 2 of 3\nThe guarantee was witheld by"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in t.truncated_texts(df).collect()} == {1, 5, 6, 10}
    assert {r.id: r.line for r in t.open_tails(df, "doc_id", "text").collect()}[1].endswith("at the site in Dorvan. The guarantee was with")
