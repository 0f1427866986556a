import random

import numpy as np
import pytest

from strandweave.llm import leaks

SYLLABLES = ["bar", "den", "fil", "gor", "hem", "jut", "kal", "lom", "mir", "nus", "pel", "rad", "sto", "tuv", "wex", "zan"]


def sentence(rnd, n):
    return ["".join(rnd.choice(SYLLABLES) for _ in range(3)) for _ in range(n)]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, 0) for i, t in items.items()], "item_id long, text string, doc_id int")
    return {(r.item_id, r.doc_id) for r in leaks.leaked_passages(d, e, **kw).collect()}


def test_cases_and_near_misses(spark):
    rnd = random.Random(2)
    item = sentence(rnd, 60)
    other = sentence(rnd, 60)
    noise = lambda: " ".join(sentence(rnd, 80))
    put = lambda words: f"{noise()}. {' '.join(words)}, {noise()}"
    edited = item[10:40]
    for i in (4, 13, 22):
        edited[i] = "████"
    left_out = [w for i, w in enumerate(item[5:45]) if i not in (9, 20, 30)]
    broken = item[20:38]
    text = " ".join(item[:40])
    cut = text.index(" ", 120) - 2
    docs = {
        1: put(item[30:48]),
        2: put(item[30:47]),  # one word short
        3: put([w.upper() + "!" for w in item[:25]]),
        4: put(edited),
        5: put(left_out),
        6: put(broken[:9][::-1] + broken[9:][::-1]),  # another order
        7: noise(),
        8: noise() + "\n" + text[:cut] + "-\n" + text[cut:] + "\n" + noise(),
        9: noise() + "\n" + " ".join(item[:12]) + "\n\n- HC-74/000337, Seite 3 -\n\n" + " ".join(item[12:30]) + "\n" + noise(),
        10: put([w for i, w in enumerate(item[:54]) if i % 3]),  # every third word missing
        11: None,
        12: "",
        13: put(item) + put(item) + put(other[10:50]),
        14: " ".join(item[:30]) * 1 + " " + "long " * 20000,
        15: put(item[:10]) + put(item[10:20]),  # not in one stretch
    }
    items = {1: " ".join(item), 2: " ".join(other), 3: None, 4: "", 5: "few words"}
    got = found(spark, docs, items)
    assert found(spark, docs, items, index_words=0) == got == {(1, d) for d in (1, 3, 4, 5, 8, 9, 13, 14)} | {(2, 13)}


def test_the_join_gives_the_same_as_the_index(spark):
    rnd = random.Random(5)
    items = {i: " ".join(sentence(rnd, 40)) for i in range(6)}
    docs = {i: " ".join(sentence(rnd, 30)) + " " + items[i % 6] for i in range(12)}
    assert found(spark, docs, items, index_words=1) == found(spark, docs, items) == {(i % 6, i) for i in range(12)}


def test_empty_tables(spark):
    assert found(spark, {1: "some words here"}, {1: None}) == set()


def test_every_fingerprint_within_the_radius_is_found():
    rnd = np.random.default_rng(3)
    index = leaks.ItemIndex([(1, " ".join(sentence(random.Random(1), 300)))])
    near = []
    for w in range(0, len(index.fp), 7):
        bits = rnd.choice(64, rnd.integers(0, leaks.RADIUS + 1), replace=False)
        near.append(index.fp[w] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)))
    fp = np.concatenate([np.array(near, dtype=np.uint64), rnd.integers(0, 1 << 63, 500).astype(np.uint64)])
    left, right = index.near(fp)
    want = {(i, j) for i in range(len(fp)) for j in range(len(index.fp)) if bin(int(fp[i] ^ index.fp[j])).count("1") <= leaks.RADIUS}
    assert set(zip(left.tolist(), right.tolist())) == want and len(left) == len(want)


def test_fingerprints_within_the_radius_share_a_pair_of_blocks():
    rnd = np.random.default_rng(6)
    fp = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
    moved = fp.copy()
    for i in range(len(fp)):
        for b in rnd.choice(64, leaks.RADIUS, replace=False):
            moved[i] ^= np.uint64(1) << np.uint64(b)
    met = np.any([a == b for a, b in zip(leaks.pair_keys(fp), leaks.pair_keys(moved))], axis=0)
    assert met.all() and len(leaks.pair_keys(fp)) == 10
    strange = np.any([a == b for a, b in zip(leaks.pair_keys(fp), leaks.pair_keys(fp[::-1].copy()))], axis=0)
    assert strange.mean() < 0.01


def test_simhash_is_the_majority_of_bits():
    h = np.random.default_rng(0).integers(0, 1 << 63, 30).astype(np.uint64)
    got = leaks.simhash(h)
    for i in range(len(h) - leaks.WINDOW + 1):
        bits = [sum(int(x) >> b & 1 for x in h[i : i + leaks.WINDOW]) > leaks.WINDOW // 2 for b in range(64)]
        assert int(got[i]) == sum(v << b for b, v in enumerate(bits))


@pytest.mark.parametrize("text,words", [("Große Häuser’s", ["grosse", "hausers"]), ("over-\n  lap", ["overlap"]), ("1,5 a/b 2/3", ["1,5", "a", "b", "2/3"]), ("ﬁn café", ["fin", "cafe"])])
def test_words(text, words):
    assert leaks.words_of(text) == words


@pytest.mark.parametrize("index_words", [0, 500_000])
def test_repeated_and_null_ids(spark, index_words):
    words = " ".join(sentence(random.Random(7), 40))
    d = spark.createDataFrame([(1, words), (1, words), (1, "short text"), (None, words), (2, "x " + words)], "doc_id long, text string")
    e = spark.createDataFrame([(5, words), (5, words), (5, "other item"), (None, words)], "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in leaks.leaked_passages(d, e, index_words=index_words).collect())
    assert got == [(5, 1), (5, 2)]
