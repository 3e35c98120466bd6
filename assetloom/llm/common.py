"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.session import cut_lineage

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"  # U+0020 and U+0009 to U+000D

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with lines below until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, a null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``kept``, one of those alike in both, in its columns.

    ``rows`` and ``kept`` hold ``(doc_id, body)``, of every row and of those that
    stay, each once; ``body`` is the ``xxhash64`` of the text. Most rows stay as
    they are: documents meet the keys that go, or that occur more than once, and
    where these are few no text moves.
    """
    doc, body = fresh(docs, "kept_id"), fresh(docs, "kept_body")
    keys = rows.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n"))
    stays = kept.select(F.col("doc_id").alias("own"), F.col("body").alias("text"), F.lit(True).alias("stays"))
    met = keys.join(stays, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("body") == F.col("text")), "left")
    odd = met.where("stays IS NULL OR n > 1").select(F.col("doc_id").alias(doc), F.col("body").alias(body), "stays")
    odd = cut_lineage(odd, "odd-keys")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(body))
    most = docs.join(odd.select(doc, body), same, "left_anti")
    again = docs.join(odd.where("stays").select(doc, body), same).dropDuplicates([doc, body])
    return most.select(*docs.columns).unionByName(again.select(*docs.columns))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else left. ``lower`` does just that on pure ASCII and is faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def small_batches(batches: Batches, most_bytes: int = 2 << 20) -> Batches:
    """The same rows in slices of about ``most_bytes``, so that long texts do not pile up in Python."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls, and where each row's start; the last number is their count."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def as_lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and the length at the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(change), n)


def whole_runs(batches: Batches, keys: list[str]) -> Iterable[pa.Table]:
    """Rows sorted by ``keys``, dealt so that no run of equal keys is cut between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        starts = runs([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cut = int(starts[-2])
        if held and (cut or any(held[-1].column(k)[held[-1].num_rows - 1] != v for k, v in zip(keys, last, strict=True))):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
