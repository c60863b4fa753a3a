"""Lines that stand in several documents, kept in the first one only. DataFrame functions alone.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case; keys
under ``least`` code points are left alone. A key is known by two 64-bit hashes. The lines of all
documents become rows (hashes, doc_id, place), are dealt into ranges of their hashes and sorted
by hashes, document and place; each range is read once, front to back, and a line goes if the first line
of its key stands in another document. What goes is gathered as bits, 64 lines to a word, and
comes back as a bitmap for each document, compressed: words that keep all their lines aren't
stored, but counted in front of the next word. Texts take no part until ``apply`` joins them with
the bitmaps.

Keys with a large share of the lines would all be in one range. A sample of at most some
``SAMPLE`` lines names them (so there are at most ``SAMPLE / OFTEN`` of them, a table of proven
size), and they are aggregated before anything is shuffled: the first and last document of each
decide on all its lines where they are. The sample steers only; results don't depend on it.

Defined results: a null or empty text is one empty line. Rows without a doc_id take no part: they
keep their lines and take none from others. Rows of one doc_id are one document; each keeps its
own lines and has its own bitmap, known by the text's hash. Repeats within the document that
holds a key first all stay. A text may lose all lines and is empty then. Ties can't occur, as only documents are compared. An
empty table has an empty result. Documents that lose nothing have no bitmap; ``apply`` keeps the
columns of the documents and replaces those of the names it adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialise

#: Keys of fewer code points are left alone.
LEAST = 10
#: Lines of the sample that names frequent keys, and how many of one key make it frequent.
SAMPLE, OFTEN = 1 << 17, 128
#: ASCII white space, and the letters that count as equal; fixed values.
WHITE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a bitmap with all lines kept.
ALL = -1

# columns beside those of a table
LINES, WORDS, TEXT_HASH, DOC, ROW, DROPPED, KEEP = (f"__graphloom_{x}" for x in ("lines", "words", "text_hash", "doc", "row", "dropped", "keep"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``a, b`` (hashes of the key), ``doc, row`` (which document, which of its rows), ``place`` of each
    line with a key that is long enough."""
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), _text_hash(F.col(text)).alias("row"), lines(F.col(text)).alias("lines"))
    each = named.select("doc", "row", F.posexplode("lines").alias("place", "line")).select("doc", "row", "place", key(F.col("line")).alias("key"))
    each = each.where(F.char_length("key") >= least)
    return each.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"), "doc", "row", "place")


def frequent(found: DataFrame, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """Keys with about ``often / sample`` of all lines or more."""
    n = found.count()
    share = F.pmod(F.xxhash64("doc", "row", "place"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    return found.where(share).groupBy("a", "b").count().where(F.col("count") >= often).select("a", "b")


def _first_documents(found: DataFrame, hot: DataFrame) -> DataFrame:
    """Lines of frequent keys that go: each against the first document of its key, aggregated ahead."""
    own = found.join(F.broadcast(hot), ["a", "b"], "left_semi")  # at most sample / often keys
    first = own.groupBy("a", "b").agg(F.min("doc").alias("first"))
    return own.join(F.broadcast(first), ["a", "b"]).where("doc > first")


def _streamed(found: DataFrame) -> DataFrame:
    """Lines that go: ranges of hashes, each sorted by hashes, document and place, and read once."""
    ranged = found.repartitionByRange("a", "b")
    first = F.first("doc").over(W.partitionBy("a", "b").orderBy("doc", "row", "place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.select("*", first.alias("first")).where("doc > first")


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """For each document (``doc``, and ``row``: the hash of its text) that loses lines: ``n_dropped``, and
    ``keep``, a list of (``full``, ``word``): so many words of 64 lines that all stay, then a word whose bit
    i stands for its i-th line. Lines behind the last word stay."""
    found = materialise(keyed_lines(docs, text, doc_id, least), "line_hashes")
    hot = materialise(frequent(found, sample, often), "frequent_lines")
    rest = found.join(F.broadcast(hot), ["a", "b"], "left_anti")
    gone = _first_documents(found, hot).select("doc", "row", "place").unionByName(_streamed(rest).select("doc", "row", "place"))
    word, bit = F.floor(F.col("place") / 64).alias("at"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = gone.groupBy("doc", "row", word).agg(F.bit_or(bit).alias("gone"))
    each = words.groupBy("doc", "row").agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("at", F.bitwise_not("gone").alias("word")))).alias("words"))
    skipped = F.transform("words", lambda w, i: F.struct((w["at"] - F.coalesce(F.get(F.col("words"), i - 1)["at"], F.lit(-1)) - 1).cast("int").alias("full"), w["word"].alias("word")))
    return materialise(each.select("doc", "row", "n_dropped", skipped.alias("keep")), "keep_bitmaps")


def words_of(keep: Column) -> Column:
    """The words of a compressed bitmap, one for every 64 lines up to the last that isn't full."""
    return F.flatten(F.transform(keep, lambda r: F.concat(F.array_repeat(F.lit(ALL).cast("long"), r["full"]), F.array(r["word"]))))


def apply(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept``, the lines that stay."""
    marks = bitmaps.select(F.col("doc").alias(DOC), F.col("row").alias(ROW), F.col("n_dropped").alias(DROPPED), F.col("keep").alias(KEEP))
    both = docs.withColumn(TEXT_HASH, _text_hash(F.col(text))).join(marks, (F.col(doc_id) == F.col(DOC)) & (F.col(TEXT_HASH) == F.col(ROW)), "left")
    split = both.select("*", lines(F.col(text)).alias(LINES), words_of(F.col(KEEP)).alias(WORDS))
    stays = F.expr(f"filter({LINES}, (line, i) -> coalesce((shiftrightunsigned(get({WORDS}, cast(i div 64 as int)), i % 64) & 1L) = 1L, true))")
    kept = F.when(F.col(WORDS).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    added = {"n_lines": F.size(LINES).cast("long"), "n_dropped": F.coalesce(DROPPED, F.lit(0)).cast("long"), "kept": kept}
    return split.select(*[c for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])
