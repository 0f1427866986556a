"""Encoding a corpus with a public byte-level BPE tokenizer through a table of distinct words.

Texts are split into words in Spark, each distinct word is encoded once, and the ids are joined back by position. Words
never span a split, so a text's ids are those of its words in order.

Scale: the words of a text are rows only where it pays. A word with at least a ``FREQUENT``-th of all occurrences, and
more in proportion the longer it is, is frequent; whatever the corpus, there are at most ``FREQUENT`` such words with at most
``LONGEST`` times as many characters in all. So their table is broadcast and the ids of their occurrences are looked up
column-wise in Arrow. The other words of a text become (document, position, word) rows, each once per text with its place
in the text's list of them, are joined by word with a shuffle and put back into their positions.

Null, empty and blank texts have defined ids: null and empty ones an empty list, blank ones those of their white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
FREQUENT = 1 << 17
LONGEST = 64
_S = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The word pattern of the tokenizer (fixed value), with white space spelled out as Unicode has it. Alternatives that
# cannot start alike may stand in any order: the usual ones come first.
WORDS = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def word_table(texts: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``word``, ``n`` (occurrences) and ``ids`` of each distinct word of the corpus, each encoded once.

    The vocabulary file is read on the driver and sent to the tasks (its size is fixed)."""
    with open(vocabulary, encoding="utf-8") as f:
        model = texts.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text
        for b in batches:
            ids = [x.ids for x in tokenizer.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, schema.field(2).type)], schema=schema)

    counts = texts.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.mapInArrow(run, "word string, n long, ids array<int>")


def _split_batches(frequent: pa.Table, want_ids: bool):
    """Arrow stage over (id, two hashes, words): the ids of frequent words, with ``-1 - k`` for a text's ``k``-th other word; or
    those other words, each once per text, in the order of their first places."""
    words, ids = frequent.column("word").combine_chunks(), frequent.column("ids").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_arrays([ids, pa.array([[0]], ids.type)])
        for b in batches:
            lists = b.column(3)
            lists = lists.cast(pa.list_(pa.string())) if lists.type != pa.list_(pa.string()) else lists
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            at = pc.index_in(flat, value_set=words)
            missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            other = flat.take(pa.array(missing))
            doc = np.searchsorted(offsets, missing, side="right") - 1
            code = other.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, first, of = np.unique(doc.astype(np.int64) << 32 | code, return_index=True, return_inverse=True)
            order = np.argsort(first, kind="stable")
            starts = np.searchsorted(doc[first[order]], np.arange(len(lists) + 1))
            if want_ids:
                rank = np.empty(len(first), np.int64)
                rank[order] = np.arange(len(first))
                pieces = table.take(pc.fill_null(at, len(words)))
                ends = np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy())] if len(pieces) else np.zeros(1, np.int64)
                out = np.array(pieces.flatten().to_numpy(zero_copy_only=False), dtype=np.int32)
                out[ends[missing]] = -1 - (rank[of] - starts[doc])
                made = pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(out))
            else:
                made = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), other.take(pa.array(first[order])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), made], names=["_id", "_h1", "_h2", "_out"])

    return run


def _fill_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids with holes, the ids of each other word) to (id, ids)."""
    for b in batches:
        lists, fills = b.column(1), b.column(2)
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        pieces = fills.flatten()  # null lists of fills hold nothing
        width = np.ones(len(flat), np.int64)
        hole = np.flatnonzero(flat < 0)
        values, piece_at, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(hole):
            lengths = pc.list_value_length(pieces).to_numpy().astype(np.int64)
            values, begin = pieces.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)[:-1]]
            of = pc.fill_null(pc.list_value_length(fills), 0).to_numpy()
            first = np.r_[0, np.cumsum(of)][np.searchsorted(offsets, hole, side="right") - 1]
            which = first - 1 - flat[hole]
            piece_at, size = begin[which], lengths[which]
            width[hole] = size
        ends = np.r_[0, np.cumsum(width)]
        out = np.empty(ends[-1], np.int32)
        plain = flat >= 0
        out[ends[:-1][plain]] = flat[plain]
        if len(hole):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(ends[:-1][hole], size) + step] = values[np.repeat(piece_at, size) + step]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(out))], names=["_id", "ids"]
        )


def encode_corpus(
    texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, frequent: int = FREQUENT, longest: int = LONGEST
) -> DataFrame:
    """``key`` (a bigint) and ``ids`` of every row, repeated rows and null keys too. Extra columns are not read."""
    table = cut_lineage(word_table(texts, text, vocabulary))
    total = table.agg(F.sum("n")).first()[0] or 0
    # the share asked for grows with the length, so that the characters of all frequent words are bounded too
    known = F.col("n") * float(frequent * longest) >= float(total) * F.greatest(F.lit(longest), F.length("word"))
    few = table.filter(known).select("word", "ids").toArrow()
    few = few.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))]))
    # Rows of one key are told apart by 128 bits of hash; a key that is not null and has one row needs none.
    key_of = F.col(key).cast("long")
    repeated = not texts.filter(key_of.isNotNull()).groupBy(key_of).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()
    own = lambda h: h if repeated else F.when(key_of.isNull(), h)
    h1, h2 = own(F.xxhash64(text)), own(F.xxhash64(F.lit(1), text))
    words = texts.select(key_of.alias("_id"), h1.alias("_h1"), h2.alias("_h2"), split_words(F.col(text)).alias("_words"))
    holed = words.mapInArrow(_split_batches(few, True), "_id long, _h1 long, _h2 long, _out array<int>")
    rare = words.mapInArrow(_split_batches(few, False), "_id long, _h1 long, _h2 long, _out array<string>")
    rows = rare.select("_id", "_h1", "_h2", F.posexplode("_out").alias("_pos", "word"))
    others = table.filter(~known).select(F.col("word").alias("_word"), F.col("ids").alias("_ids"))
    # by key and hashes of the text, each word once: repeated rows and repeated or null keys do no harm
    fills = (
        rows.join(others, F.col("word") == F.col("_word"))
        .groupBy("_id", "_h1", "_h2")
        .agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("_pos", "_ids")))).alias("_fills"))
        .select(F.col("_id").alias("_fid"), F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2"), F.col("_fills._ids").alias("_fills"))
    )
    same = F.col("_id").eqNullSafe(F.col("_fid")) & F.col("_h1").eqNullSafe(F.col("_f1")) & F.col("_h2").eqNullSafe(F.col("_f2"))
    whole = holed.join(fills, same, "left").select("_id", "_out", "_fills")
    return whole.mapInArrow(_fill_batches, "_id long, ids array<int>").withColumnRenamed("_id", key)


def piece_table(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` and ``piece`` (binary) of the vocabulary: a fixed table."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from code point 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    rows = [(i, bytes(byte_of[c] for c in piece)) for piece, i in vocab.items() if all(c in byte_of for c in piece)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(encoded: DataFrame, key: str, pieces: DataFrame) -> DataFrame:
    """``key`` and ``text`` from ids: each id is joined with its piece, and the pieces of a row are put together in
    order. The table of pieces has the fixed size of the vocabulary, so it is broadcast."""
    rows = encoded.select(F.col(key).alias("_k"), F.posexplode_outer("ids").alias("_pos", "_tid"))
    found = rows.join(F.broadcast(pieces), F.col("_tid") == F.col("id"), "left")
    parts = F.sort_array(F.collect_list(F.struct("_pos", F.hex("piece").alias("_h"))))
    return found.filter(F.col("_pos").isNotNull() | F.col("_tid").isNull()).groupBy("_k").agg(parts.alias("_p")).select(
        F.col("_k").alias(key),
        F.decode(F.unhex(F.concat_ws("", F.transform(F.col("_p"), lambda p: F.coalesce(p["_h"], F.lit(""))))), "UTF-8").alias("text"),
    )
