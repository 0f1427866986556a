import os
import random

import pytest

from strandweave.llm import tokens

TEXTS = [
    None, "", " ", "  \n\t ", "plain words", "don't I'll we've 'tis 's''s", "  leading", "trailing  ", "a\r\nb\n\n c", "naïve über café ﬁn",
    " nbsp thin　wide", "123abc 45.6%", "⚖️ \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> text <|endoftext|>", "x" * 5000, "中文 рус مرح",
    "tab\there", "-- ... !!!", "�\x00\x01", " line sep\x85nel\x1c", "A" * 30 + " " * 30 + "B",
]


@pytest.fixture(scope="module")
def reference():
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    return df, tokens.encode_corpus(df, "doc_id", "text", **kw)


@pytest.mark.parametrize("frequent", [1, 20, 1 << 17])
def test_ids_equal_those_of_whole_texts(spark, reference, frequent):
    rnd = random.Random(frequent)
    pieces = [t for t in TEXTS if t] + list(" \n'.,-7é")
    texts = TEXTS + ["".join(rnd.choice(pieces)[:40] for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    _, out = run(spark, texts, frequent=frequent)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == reference(t), repr(t)


def test_round_trip(spark, reference):
    df, out = run(spark, TEXTS)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(out, "doc_id", tokens.piece_table(spark)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_each_distinct_word_is_encoded_once(spark, reference):
    df, _ = run(spark, ["a b a b", "a b", None])
    table = tokens.word_table(df, "text").collect()
    assert sorted((r.word, r.n) for r in table) == [(" a", 1), (" b", 3), ("a", 2)]


def test_empty(spark, reference):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(df, "doc_id", "text").count() == 0


@pytest.mark.parametrize("frequent", [1, 1 << 17])
def test_repeated_and_null_keys(spark, reference, frequent):
    rows = [(1, "some rare words here"), (1, "some rare words here"), (1, "other words, with 7 more"), (None, "null key words"), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", frequent=frequent).collect())
    assert got == sorted((str(k), reference(t)) for k, t in rows)


def test_null_keys_whose_texts_share_a_short_hash(spark, reference):
    from pyspark.sql import functions as F

    texts = ["zq16737 vortex91959", "zq23D37 vortex146743"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    for rows in (df, df.unionAll(df)):
        got = sorted((str(r.doc_id), r.ids) for r in tokens.encode_corpus(rows, "doc_id", "text", frequent=1).collect())
        assert got == sorted((str(r.doc_id), reference(r.text)) for r in rows.collect())


def test_long_words_in_many_texts(spark, reference):
    texts = ["=" * 3000 + f" {i} " + "ab" * (i % 7) for i in range(60)] + ["-" * 70] * 30
    for frequent in (4, 50, 1 << 17):
        _, out = run(spark, texts, frequent=frequent)
        assert {r.doc_id: r.ids for r in out.collect()} == {i: reference(t) for i, t in enumerate(texts)}
