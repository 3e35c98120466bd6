"""Line dedup in built-in functions only.

Hashes of line keys are range-partitioned with documents and positions as
secondary sort. A hash that many documents share is so spread over many
partitions, and each partition streams it into one row. Documents get back a
compressed bitmap of the lines they keep; text meets only its own bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import BLANKS, ascii_lower, fresh, text_of
from assetloom.session import cut_lineage

# A document without an id stands below all others and counts as one.
NO_ID = -(2**63)


def _lines() -> Column:
    return F.split(text_of(), "\n", -1)


def _row_key() -> list[Column]:
    """Rows with equal ids and texts share a bitmap; equal ids with other texts do not."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of()).alias("body")]


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(h1, h2, doc, body, pos)`` for every line whose key has ``least_chars`` code points.

    The key is the line with blanks stripped at both ends and A-Z lower-cased;
    two 64-bit hashes stand for it.
    """
    lines = docs.select(*_row_key(), F.posexplode(_lines()).alias("pos", "line")).where(
        F.char_length("line") >= least_chars
    )
    keyed = lines.select("doc", "body", "pos", F.trim("line", F.lit(BLANKS)).alias("line"))
    key = ascii_lower(F.col("line"))
    return keyed.where(F.char_length("line") >= least_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc", "body", "pos"
    )


def shared_lines(hashes: DataFrame, least_docs: int) -> DataFrame:
    """``(h1, h2, keeper)``: hashes found in ``least_docs`` documents, and the largest of these.

    The range step sorts each hash by falling document, so a slice folds a
    document's lines, and then a hash's documents, as a stream.
    """
    ranged = hashes.select("h1", "h2", "doc", "pos").repartitionByRange("h1", "h2", F.desc("doc"))
    ranged = ranged.sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    by_doc = ranged.groupBy("h1", "h2", "doc").agg(F.min("pos").alias("first"))
    by_hash = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
    return by_hash.where(F.col("docs") >= least_docs).select("h1", "h2", "keeper")


def line_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``(doc, body, words)`` for documents that lose lines.

    ``words`` is the compressed bitmap: ``(at, keep)`` for each block of 64 lines
    that loses some, with a set bit for each line kept; blocks not listed keep
    all. It is as long as the document at most. Tables without rows, or without
    shared lines, give no rows.
    """
    hashes = cut_lineage(line_hashes(docs, least_chars), "line-hashes")
    # Most hashes have one document: what is shared is small and written once.
    shared = cut_lineage(shared_lines(hashes, least_docs), "shared-lines")
    lost = hashes.join(shared, ["h1", "h2"]).where("doc <> keeper")
    block = F.floor(F.col("pos") / 64).cast("int").alias("at")
    bit = F.expr("bit_or(shiftleft(1L, pos % 64))")
    words = lost.groupBy("doc", "body", block).agg(F.bitwise_not(bit).alias("keep"))
    return words.groupBy("doc", "body").agg(F.sort_array(F.collect_list(F.struct("at", "keep"))).alias("words"))


def _dense(words: Column) -> Column:
    """The bitmap with the blocks between listed ones filled in, for access by index."""
    gap = lambda w, i: w["at"] - F.when(i > 0, F.get(words, i - 1)["at"]).otherwise(-1) - 1
    return F.flatten(
        F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(w, i)), F.array(w["keep"])))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, into: str = "lines") -> DataFrame:
    """``docs`` and a struct column ``into``: ``kept`` (the text of kept lines), ``n_lines`` and ``n_dropped``.

    Null texts are read as one empty line. A column already named ``into`` is
    replaced, all others stay, whatever their names.
    """
    doc, body = _row_key()
    doc_of, body_of, words_of, dense = (fresh(docs, f"{into}_{x}") for x in ("doc", "body", "words", "dense"))
    own = bitmaps.select(F.col("doc").alias(doc_of), F.col("body").alias(body_of), F.col("words").alias(words_of))
    met = docs.join(own, (doc == F.col(doc_of)) & (body == F.col(body_of)), "left")
    words = F.col(words_of)
    met = met.withColumn(dense, _dense(words))
    block = lambda i: F.coalesce(F.get(F.col(dense), F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    stays = F.filter(_lines(), lambda line, i: F.getbit(block(i), i % 64) == 1)
    lost = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + 64 - F.bit_count(w["keep"]))
    out = F.struct(
        F.when(words.isNull(), text_of()).otherwise(F.array_join(stays, "\n")).alias("kept"),
        F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"),
    )
    return met.withColumn(into, out).drop(doc_of, body_of, words_of, dense)


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` without the shared lines, in the same columns; ``n_chars`` follows if there is one.

    A document of nothing but shared lines stays, with an empty text.
    """
    own = fresh(docs, "lines")
    out = apply_bitmaps(docs, line_bitmaps(docs, least_chars, least_docs), own).withColumn("text", F.col(f"{own}.kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)
