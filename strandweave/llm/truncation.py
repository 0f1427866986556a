"""Texts cut off by a field limit or in transfer.

Values cut short are strict prefixes of longer copies elsewhere: the self-join by prefix holds every text that ends open
(without the end of a sentence) against all texts, and its last line or paragraph against all lines, numbered or not and of
any length. A text is a case if it, or that line, goes on elsewhere before a line break. A cut text without a longer copy
is no prefix of anything; there the ending decides: a text whose last numbered paragraph ends open is a case too, with the
evidence ``ending``.

Prefixes are found by hash: each value has the hashes of its prefixes at the powers of two, so all of them cost no more
than reading the value twice; a candidate has that of its longest such prefix. Where those meet, the longer value's prefix of
exactly the candidate's length is hashed again, with two hashes. Scale: values are never compared in pairs and never sorted
together. Up to ``KEYS_BROADCAST`` different keys of candidates (48 bytes each) are broadcast. Beyond that the lengths of
the longest values under each prefix hash, without the values, meet the keys in a shuffle, and only keys that a longer
value may extend are joined with values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_counted, cut_lineage

KEYS_BROADCAST = 200_000
LEVELS = ("document", "line", "ending")
_BREAKS = "\r\x0b\x0c\x85\u2028\u2029"
_BLANK = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_END = r"[.?!][\s\"\u00bb\u201c\u201d\u2019')\]\u00a0\u202f\p{So}\ufe0f]*$"
_MARK = r"(?:\u2026|(?<![.\]])\.\.\.|\ufffd+)$"
_WITHHELD = r"(?:^|[^\p{L}])\p{Lu}\.\.\.$"
_SHORTENED = r"(?:(?:^|[\s(])(?:para|paras|Rn|Abs|consid|vgl|Nr|Art|al)\.|\u00a7)$"
_NUMBER = r"^[^\p{L}\p{N}]{0,3}(?:\p{L}{1,4}\.\s?)?[0-9]{1,4}[\])]?[.:]?\s+"
_PARAGRAPH = _NUMBER + r".*\p{L}"
# Closing lines, which follow the last paragraph and may end open.
_CLOSING = (
    r"[ \t\u00a0]*(?:[*][* ]*$|-\s.*\s-$|(?:Page|Seite)\s[0-9]+\s(?:of|von|sur)\s[0-9]+$|\((?:[Ss]igned|sign\S{1,2})\)\s|gez\.\s|Registrar of\s|Certified copy\b|"
    r"(?:Annexe?|Anlage):|Ausgefertigt:|Done at\s|Ainsi jug\S{1,2} .\s|\S+, den [0-9]{1,2}\.\s|(?:The operative part reads|Der Tenor lautet|Le dispositif porte)\s?:)"
)
_WRAPPED = r"[\p{Ll},\-][ \t]*\n[ \t]*\p{Ll}"


def _broken(text: Column) -> Column:
    """Line ends as line feeds; texts without other ones are not touched."""
    text = F.when(text.contains("\r\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    has = F.lit(False)
    for c in _BREAKS:
        has = has | text.contains(c)
    return F.when(has, F.translate(text, _BREAKS, "\n" * len(_BREAKS))).otherwise(text)


def _trimmed(value: str) -> Column:
    """Without blanks at the end, where there are any (of a column that exists, so that nothing is computed twice)."""
    return F.when(F.substring(value, -1, 1).isin(*_BLANK), F.rtrim(value, F.lit(_BLANK))).otherwise(F.col(value))


def _unmarked(values: DataFrame) -> DataFrame:
    """``value`` without blanks and a mark of a cut at the end, so that no value is longer than itself. Trimmed in a
    projection of its own: inside the condition it would be computed for each branch."""
    bare = values.select(_trimmed("value").alias("bare"))
    marked = F.substring("bare", -1, 1).isin("\u2026", "\ufffd") | F.col("bare").endswith("...")
    unmarked = F.rtrim(F.regexp_replace("bare", _MARK, ""), F.lit(_BLANK))
    return bare.select(F.when(marked, unmarked).otherwise(F.col("bare")).alias("value"))


def _ends_open(line: Column) -> Column:
    return ~line.rlike(_END) | line.rlike(_MARK) | line.rlike(_SHORTENED) | line.rlike(_WITHHELD)


def _without_closing(rows: DataFrame) -> DataFrame:
    """``whole`` without its closing lines, ``closed`` (it has some) and ``last``, the last line of the rest."""
    last = lambda: F.substring_index("whole", "\n", -1)
    bare = F.rtrim(F.regexp_replace("whole", r"(?:^|\n)" + f"(?m:{_CLOSING}).*+" + r"(?:\s*+\n" + f"(?m:{_CLOSING}).*+)*" + r"\s*\z", ""), F.lit(_BLANK))
    rows = rows.select("id", "whole", last().rlike("^" + _CLOSING).alias("closed"))
    rows = rows.select("id", F.when(F.col("closed"), bare).otherwise(F.col("whole")).alias("whole"), "closed")
    return rows.select("id", "whole", "closed", last().alias("last"))


def _joined(lines: Column) -> Column:
    """Wrapped lines as one, divided words joined."""
    lines = F.transform(lines, lambda x: F.trim(x, F.lit(_BLANK)))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"(?<=\p{L})-\n(?=\p{Ll})", ""), r"\n", " ")


def _paragraph() -> Column:
    """The last paragraph over wrapped lines: from the last line with a paragraph number to the end of the text, without an
    empty line in between; null where there is none or nothing shows that its lines are wrapped. Known closing lines
    (page numbers) inside it are left out."""
    block = F.substring_index(F.regexp_replace("whole", r"\n[^\S\n]+\n", "\n\n"), "\n\n", -1)
    lines = F.filter(F.split(block, "\n"), lambda x: ~x.rlike("^" + _CLOSING))
    start = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(_PARAGRAPH), i)))
    paragraph = F.slice(lines, start + 1, F.size(lines))
    broken = F.exists(F.slice(paragraph, F.lit(1), F.size(paragraph) - 1), lambda x: ~F.rtrim(x, F.lit(_BLANK)).rlike(_END))
    return F.when(broken | F.col("whole").rlike(_WRAPPED), _joined(paragraph))


def last_paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``whole``, ``line``, ``ruled`` and ``closed`` of the texts that end open, before known closing lines if they have
    some (``closed``: those are complete, the others are candidates). ``line`` is the last paragraph over wrapped lines if it
    is numbered (``ruled``), else the last line. See ``open_tails``."""
    rows = texts.select(F.col(key).alias("id"), _broken(F.col(text)).alias("whole")).select("id", _trimmed("whole").alias("whole"))
    rows = _without_closing(rows)
    marked = F.col("last").rlike(_MARK) & ~F.col("last").rlike(_WITHHELD)
    paragraph = F.when(F.col("last").rlike(_PARAGRAPH), F.col("last")).otherwise(_paragraph())
    case = F.when((F.col("last") != "") & _ends_open(F.col("last")), F.array(F.struct(marked.alias("marked"), paragraph.alias("paragraph"))))
    # exploded, not filtered: a filter would be pushed below the columns it reads and compute them once for each use
    unmarked = lambda c: F.when(F.col("marked"), F.rtrim(F.regexp_replace(c, _MARK, ""), F.lit(_BLANK))).otherwise(F.col(c))
    open_ones = rows.select("id", "whole", "closed", "last", F.explode(case).alias("c")).select(
        "id", "whole", "closed", "last", "c.marked", F.explode(F.array("c.paragraph")).alias("paragraph")
    )
    return (
        open_ones.select("id", "whole", "closed", "marked", F.col("paragraph").isNotNull().alias("ruled"), F.coalesce("paragraph", "last").alias("line"))
        .select("id", unmarked("whole").alias("whole"), F.regexp_replace(unmarked("line"), _NUMBER, "").alias("line"), "ruled", "closed")
    )


def open_tails(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates: ``id``, ``whole``, ``line`` (the last paragraph or line without its number) and ``ruled`` (it is a numbered
    paragraph) of the texts that end open. Marks of a cut ("...", broken characters) are taken off. A paragraph that another
    text has to the same place before its closing lines is complete. Null, empty and blank texts are none."""
    rows = cut_lineage(last_paragraphs(texts, key, text))
    complete = rows.filter(F.col("closed") & F.col("ruled")).select("line").distinct()
    return rows.filter(~F.col("closed")).drop("closed").join(complete, "line", "left_anti").select("id", "whole", "line", "ruled")


def _exact(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.hash(value).alias("h2")]


def _grid(n: Column) -> Column:
    """The powers of two up to ``n``."""
    return F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), 1, F.length(F.bin(n)))


def strict_prefixes(candidates: DataFrame, values: DataFrame, most_keys: int = KEYS_BROADCAST) -> DataFrame:
    """``id`` of the candidates (``id``, ``value``) of which a longer one of the ``values`` (``value``) is an extension that
    goes on before a line break. Null and empty values extend nothing and are extended by nothing."""
    n = F.length("value")
    known = candidates.filter(n > 0).select("id", n.alias("n"), F.array_max(_grid(n)).alias("g"), "value")
    known = known.select("id", "n", "g", F.xxhash64(F.expr("substring(value, 1, g)")).alias("h"), *_exact(F.col("value")))
    known = cut_lineage(known)
    keys, seen = cut_counted(known.select("n", "g", "h", "h1", "h2").distinct(), keys=F.count("*"))
    small = seen["keys"] <= most_keys
    grid = values.select("value", n.alias("len"), F.explode(_grid(n)).alias("vg"))  # not filtered, as above
    grid = grid.withColumn("vh", F.xxhash64(F.expr("substring(value, 1, vg)")))
    at = (F.col("vg") == F.col("g")) & (F.col("vh") == F.col("h"))
    if not small:
        longest = grid.groupBy("vg", "vh").agg(F.max("len").alias("len"))
        keys, seen = cut_counted(keys.join(longest, at).filter("len > n").select("n", "g", "h", "h1", "h2"), keys=F.count("*"))
        small = seen["keys"] <= most_keys
    met = grid.join(F.broadcast(keys) if small else keys, at).filter("len > n")
    cut, rest = F.expr("substring(value, 1, n)"), F.expr("substring(value, n + 1, 64)")
    hits = met.filter((F.xxhash64(cut) == F.col("h1")) & (F.hash(cut) == F.col("h2")) & ~rest.rlike(r"^[^\S\n]*(?:\n|$)"))
    hits = hits.select("n", "h1", "h2").distinct()
    return known.join(hits, ["n", "h1", "h2"], "left_semi").select("id")


def truncated_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", most_keys: int = KEYS_BROADCAST) -> DataFrame:
    """``key`` and ``evidence`` (``document``, ``line`` or ``ending``) of the texts that were cut off. Copies are each
    reported, repeated rows of a key once; extra columns are not read."""
    tails = cut_lineage(open_tails(texts, key, text))
    whole = _unmarked(texts.select(_broken(F.col(text)).alias("value"))).select(F.explode(F.array("value")).alias("value"))  # computed once
    lines = whole.select(F.explode(F.split("value", "\n")).alias("line"))
    lines = _unmarked(lines.select(F.regexp_replace("line", _NUMBER, "").alias("value")))
    found = tails.filter("ruled").select("id", F.lit(len(LEVELS) - 1).alias("rank"))
    for rank, (column, values) in enumerate((("whole", whole), ("line", lines))):
        one = strict_prefixes(tails.select("id", F.col(column).alias("value")), values, most_keys)
        found = found.unionAll(one.select("id", F.lit(rank).alias("rank")))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return found.groupBy("id").agg(F.get(names, F.min("rank")).alias("evidence")).withColumnRenamed("id", key)


def truncation_by_source(texts: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per source: texts that are not blank, cut ones, their share, and the length at which it cuts most often."""
    cut = truncated_texts(texts, key, text).select(F.col(key).alias("_id"), "evidence")
    rows = texts.filter(F.length(F.rtrim(text, F.lit(_BLANK))) > 0).select(
        F.col(key).alias("_rid"), F.col(source).alias("source"), F.length(text).alias("chars")
    )
    by_length = (
        rows.join(cut, F.col("_rid") == F.col("_id"), "left")
        .groupBy("source", F.when(F.col("_id").isNotNull(), F.col("chars")).alias("cut_at"))
        .agg(F.count("*").alias("w"))
    )
    top = F.max(F.when(F.col("cut_at").isNotNull(), F.struct("w", (-F.col("cut_at")).alias("at"))))
    n_cut = F.sum(F.when(F.col("cut_at").isNotNull(), F.col("w")).otherwise(0))
    return by_length.groupBy("source").agg(F.sum("w").alias("n_texts"), n_cut.alias("n_cut"), top.alias("top")).select(
        "source",
        "n_texts",
        "n_cut",
        F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("cut_share"),
        (-F.col("top.at")).alias("usual_length"),
        F.col("top.w").alias("n_at_usual_length"),
    )
