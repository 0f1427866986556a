"""Evaluation texts leaking into a corpus: which documents hold a passage of which item.

Both sides are cut into windows of ``WINDOW`` words. A case has at least ``LEAST`` words of an item in order, with
edited words at least ``APART`` apart, so it holds a window without an edit, however the edits lie. Windows are
fingerprinted by SimHash over the 64-bit hashes of their words; with seven words a fingerprint's bit is the majority of
seven bits. A document's fingerprint is held against all item fingerprints within ``RADIUS`` bits: with ``RADIUS + 1``
blocks of 16 bits at least one block agrees, so a lookup by block misses none. Candidates within the radius are verified
by the exact similarity of their windows, weighted by the length of words, and then by an alignment that follows the
passage from there in both directions.

Windows of the size of an item or of a whole passage would not do: an edited word moves so many bits that the radius misses
cases (see README for the share). Seven words is the longest window that holds no edit in every case.

Scale: the documents are scanned once, without a shuffle, against an index of the items' windows that is broadcast; its
size is checked first (``INDEX_WORDS`` words, some 30 MB). Beyond that, windows of both sides meet in a shuffle: of
``RADIUS + 2`` blocks at least two agree, so the join is by pairs of blocks, of 25 or 26 bits each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 7
LEAST = 18
APART = 9
SLACK = 2  # marks such as "&" count as words for an author but not here
RADIUS = 3
SIMILARITY = 0.8
INDEX_WORDS = 500_000
CACHE_WORDS = 1_000_000

_HEADER = re.compile(r"(?m)^[^\w\n]*[a-z]{1,4}[-\u2010-\u2015 ]?[0-9]+/[0-9]+[^\w\n]+(?:page|seite|p\.|s\.) *[0-9]+[^\w\n]*$")
_DIVIDED = re.compile(r"(?<=\w)[-\u2010\u2011\u00ad]\s*\n\s*(?=\w)")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f'\u2019\u02bc]")
_WORD = re.compile(r"[^\W_]+(?:(?<=[0-9])[/.,](?=[0-9])[^\W_]+)*")


def words_of(text: str) -> list[str]:
    """Words of a text without regard to case, accents, punctuation, line ends and page headers."""
    t = text.casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if "page" in t or "seite" in t:
        t = _HEADER.sub("", t)
    if "\n" in t:
        t = _DIVIDED.sub("", t)
    return _WORD.findall(_UNSEEN.sub("", t))


class Hasher:
    """64-bit hashes of words, kept for words seen before; the cache is emptied when it is full."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.array([known[w] for w in words], dtype=np.uint64)


def _most(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a & b) | (c & (a | b))


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each window of seven words: bit by bit the majority, by adders over whole 64-bit columns."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = [hashes[i : i + n] for i in range(WINDOW)]
    s1, c1 = x[0] ^ x[1] ^ x[2], _most(x[0], x[1], x[2])
    s2, c2 = x[3] ^ x[4] ^ x[5], _most(x[3], x[4], x[5])
    c3 = _most(s1, s2, x[6])
    return _most(c1, c2, c3)


class ItemIndex:
    """Windows of the items by each 16-bit block of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hasher = Hasher()
        self.ids, self.words, self.hashes, self.weights = [], [], [], []
        fps, owner, place = [], [], []
        for item, text in items:
            words = words_of(text)
            h = hasher(words)
            fp = simhash(h)
            owner.append(np.full(len(fp), len(self.ids), dtype=np.int32))
            place.append(np.arange(len(fp), dtype=np.int32))
            fps.append(fp)
            self.ids.append(item)
            self.hashes.append(h)
            self.weights.append(np.array([len(w) for w in words], dtype=np.int64))
        self.fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int32)
        self.blocks = []
        for b in range(RADIUS + 1):
            key = self.block(self.fp, b)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.blocks.append((np.searchsorted(key[order], np.arange(65537)).astype(np.int32), order))

    @staticmethod
    def block(fp: np.ndarray, b: int) -> np.ndarray:
        return ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int32)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into ``fp``, item window) within the radius, each once."""
        found = []
        for b, (start, order) in enumerate(self.blocks):
            key = self.block(fp, b)
            first = start[key]
            size = start[key + 1] - first
            left = np.repeat(np.arange(len(fp), dtype=np.int64), size)
            if not len(left):
                continue
            step = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            right = order[np.repeat(first, size) + step]
            apart = fp[left] ^ self.fp[right]
            close = np.bitwise_count(apart) <= RADIUS
            left, right, apart = left[close], right[close], apart[close]
            for earlier in range(b):  # found by an earlier block
                new = self.block(apart, earlier) != 0
                left, right, apart = left[new], right[new], apart[new]
            found.append(left * len(self.fp) + right)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.sort(np.concatenate(found))
        return both // max(1, len(self.fp)), both % max(1, len(self.fp))

    def similar(self, doc: np.ndarray, at: int, item: int, place: int) -> bool:
        """Weighted similarity of two windows: shared words by their lengths, against all words of the item's window."""
        mine = self.hashes[item][place : place + WINDOW]
        weight = self.weights[item][place : place + WINDOW]
        return bool(weight[np.isin(mine, doc[at : at + WINDOW])].sum() >= SIMILARITY * weight.sum())


_EDITS = ((1, 1), (0, 1), (2, 1), (3, 1))  # words of the document against one of the item


def _follow(doc: list[int], item: list[int], p: int, q: int, step: int, clean: int) -> tuple[int, list[int]]:
    """From equal words before (p, q) on: how far the item is followed, and where it was edited. An edit needs the
    words before it unedited for long enough, and equal words behind it."""
    edits: list[int] = []
    n, m = len(doc), len(item)
    while True:
        while 0 <= p < n and 0 <= q < m and doc[p] == item[q]:
            p, q, clean = p + step, q + step, clean + 1
        if not 0 <= q < m or clean < APART - 1 - SLACK and edits:
            return q, edits
        for dp, dq in _EDITS:
            a, b, run = p + dp * step, q + dq * step, 0
            while run < 3 and 0 <= a < n and 0 <= b < m and doc[a] == item[b]:
                a, b, run = a + step, b + step, run + 1
            if run >= 2 and (run == 3 or not 0 <= b < m):
                edits.append(q)
                p, q, clean = p + dp * step, q + dq * step, 0
                break
        else:
            return q, edits


def _passages(index: ItemIndex, doc: np.ndarray, hits: list[tuple[int, int]]) -> set[int]:
    """Items of which the document holds a passage; hits are (place in the document, item window)."""
    found: set[int] = set()
    done: list[tuple[int, int, int, int]] = []
    words = None
    for at, window in hits:
        item, place = int(index.owner[window]), int(index.place[window])
        if item in found or any(i == item and lo <= place < hi and abs(place - at - d) <= 8 for i, lo, hi, d in done):
            continue
        if not index.similar(doc, at, item, place):
            continue
        if words is None:
            words = doc.tolist()
        theirs = index.hashes[item].tolist()
        # the window itself need not be equal word by word: start from its longest equal run
        best, run = (0, 0), 0
        for i in range(WINDOW):
            run = run + 1 if words[at + i] == theirs[place + i] else 0
            best = max(best, (run, i + 1))
        if best[0] < 3:
            continue
        p, q = at + best[1], place + best[1]
        right, _ = _follow(words, theirs, p, q, 1, 0)
        left, _ = _follow(words, theirs, p - best[0] - 1, q - best[0] - 1, -1, best[0])
        if right - left - 1 >= LEAST:
            found.add(item)
        done.append((item, left + 1, right, place - at))
    return found


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", index_words: int = INDEX_WORDS
) -> DataFrame:
    """``item_id`` and ``doc_id`` of every document that holds at least ``LEAST`` words of an item in one stretch.

    Null and empty texts on either side match nothing; items shorter than a window match nothing; rows with a
    null id match nothing. Each pair comes out once, repeated rows or not. Only the named columns are read.
    """
    pick = lambda df, c: df.select(F.col(c).cast("long").alias("_id"), F.col(text).alias("_text")).filter(
        F.col("_id").isNotNull() & F.col("_text").isNotNull()
    )
    docs, known = pick(documents, doc_id), pick(items, item_id)
    words = known.agg(F.sum(F.size(F.split("_text", r"\s+")))).first()[0] or 0
    if words > index_words:
        return _by_join(docs, known)
    index = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in known.collect()])
    return docs.mapInArrow(_scan(index), "item_id long, doc_id long").distinct()


def pair_keys(fp: np.ndarray) -> list[np.ndarray]:
    """For each pair of the ``RADIUS + 2`` blocks of the fingerprints, the bits of both and the number of the pair."""
    n = RADIUS + 2
    cuts = [64 * i // n for i in range(n + 1)]
    part = [(fp >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    wide = np.uint64(max(hi - lo for lo, hi in zip(cuts, cuts[1:])))
    pairs = [(i, j) for j in range(n) for i in range(j)]
    return [(((part[i] << wide) | part[j]) * np.uint64(len(pairs)) + np.uint64(k)).astype(np.int64) for k, (i, j) in enumerate(pairs)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to one row for each window and pair of blocks of its fingerprint."""
    hasher = Hasher()
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            b = whole.slice(i, 64)
            ids, places, fps = [], [], []
            for own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp = simhash(hasher(words_of(t)))
                ids.append(np.full(len(fp), own, np.int64))
                places.append(np.arange(len(fp), dtype=np.int32))
                fps.append(fp)
            own, place, fp = np.concatenate(ids), np.concatenate(places), np.concatenate(fps)
            for key in pair_keys(fp):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(place), pa.array(fp.view(np.int64)), pa.array(key)], names=["_own", "_place", "_fp", "_key"]
                )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item id, item text, document id, document text, places of close windows in both) to the pairs that hold."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])
    hasher = Hasher()
    for b in batches:
        pairs = []
        for item, theirs, doc, mine, hits in zip(*(b.column(k).to_pylist() for k in range(5))):
            index, doc_words = ItemIndex([(item, theirs)]), hasher(words_of(mine))
            # under a repeated id, a place may be that of another text
            near = sorted((h["at"], h["place"]) for h in hits if h["at"] + WINDOW <= len(doc_words) and h["place"] < len(index.fp))
            if _passages(index, doc_words, near):
                pairs.append((item, doc))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for items of any number: windows of both sides meet in a shuffle by pairs of blocks of their fingerprints.
    A pair of texts has at most one row per window of the item in ``hits``."""
    form = "_own long, _place int, _fp long, _key long"
    mine = docs.mapInArrow(_windows, form).select(F.col("_own").alias("doc"), F.col("_place").alias("at"), F.col("_fp").alias("dfp"), F.col("_key").alias("dkey"))
    theirs = items.mapInArrow(_windows, form).select(F.col("_own").alias("item"), "_place", F.col("_fp").alias("ifp"), F.col("_key").alias("ikey"))
    close = mine.join(theirs, F.col("dkey") == F.col("ikey")).filter(F.bit_count(F.col("dfp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    first = close.groupBy("item", "doc", "_place", (F.col("at") - F.col("_place")).alias("shift")).agg(F.min("at").alias("at"))
    hits = first.groupBy("item", "doc").agg(F.collect_list(F.struct("at", F.col("_place").alias("place"))).alias("hits"))
    both = hits.join(items.select(F.col("_id").alias("item"), F.col("_text").alias("theirs")), "item")
    both = both.join(docs.select(F.col("_id").alias("doc"), F.col("_text").alias("mine")), "doc")
    return both.select("item", "theirs", "doc", "mine", "hits").mapInArrow(_verify, "item_id long, doc_id long").distinct()


def _scan(items):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = ItemIndex(items.value), Hasher()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                split = [words_of(t) for t in b.column(1).to_pylist()]
                flat = hasher([w for ws in split for w in ws])
                ends = np.cumsum([len(ws) for ws in split])
                fp = simhash(flat)
                # windows across two documents are none
                doc = np.searchsorted(ends, np.arange(len(fp)), side="right")
                inside = np.flatnonzero(doc == np.searchsorted(ends, np.arange(len(fp)) + WINDOW - 1, side="right"))
                left, right = index.near(fp[inside])
                left = inside[left]
                pairs = []
                if len(left):
                    of = doc[left]
                    for d in np.unique(of):
                        lo, hi = (ends[d - 1] if d else 0), ends[d]
                        own = of == d
                        hits = list(zip((left[own] - lo).tolist(), right[own].tolist()))
                        for item in _passages(index, flat[lo:hi], hits):
                            pairs.append((index.ids[item], b.column(0)[int(d)].as_py()))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    return run
