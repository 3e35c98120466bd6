"""Resampling towards a target distribution by hashed n-gram importance.

Features are the runs of one to three words, each hashed by CRC-32 into one of
``BUCKETS``. A document's weight sums the gains of its features' buckets: the
log-ratio of a bucket's share in the target texts and in all documents. Gumbel
noise from the id turns the highest scores into a draw without replacement.

The vocabulary has a head and a tail. The head is broadcast: the CRC states of
frequent words, and states and buckets of the pairs of the most frequent. All
other features are hashed directly, a state going on over the bytes that follow.
CRC-32 is linear, so for blocks of words this is done by tables; both ways give
the same numbers, and what the head holds changes no result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, fresh, small_batches, text_of
from assetloom.operators.ranking import ranked, running_total
from assetloom.session import cut_lineage

BUCKETS, RUN = 10_000, 3
# Head words, those whose pairs are tabulated, and bytes a head word may have: at most 8 MB in all.
HEAD, PAIRED, LONG = 8192, 1024, 64
PIECE = 1 << 20  # bytes of text at work at once

# Letters are lower-cased; what is no word becomes a blank. Bytes of 128 and more belong to words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _moves() -> np.ndarray:
    """``[length, k, byte]``: what byte ``k`` of a state becomes once ``length`` bytes follow; parts are XORed."""
    parts = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [parts]
    for _ in range(LONG + 1):
        last = out[-1]
        out.append((last >> 8) ^ _CRC[last & 0xFF])
    return np.array(out, np.uint32)


_MOVES = _moves()


def _moved(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    flat, at = _MOVES.reshape(-1), length * 1024
    out = flat[at + (state & 0xFF)]
    for k in range(1, 4):
        out ^= flat[at + (256 * k) + ((state >> np.uint32(8 * k)) & 0xFF)]
    return out


def split_words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Head:
    """Frequent words, most frequent first. Its size is bounded by ``HEAD``, ``PAIRED`` and ``LONG``."""

    number: dict[bytes, int]
    state: np.ndarray  # CRC after the word
    spaced: np.ndarray  # CRC of a blank and the word
    length: np.ndarray
    pair_state: np.ndarray  # [first, second] of the paired words
    pair_bucket: np.ndarray

    @staticmethod
    def of(words: list[bytes]) -> Head:
        words = [w for w in words if len(w) <= LONG][:HEAD]
        state = np.array([zlib.crc32(w) for w in words], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        length = np.array([len(w) for w in words], np.int32)
        n = min(PAIRED, len(words))
        first = np.broadcast_to(state[:n, None], (n, n))
        pairs = _moved(first, np.broadcast_to(length[:n] + 1, (n, n))) ^ spaced[:n]
        return Head({w: i for i, w in enumerate(words)}, state, spaced, length, pairs, (pairs % BUCKETS).astype(np.uint16))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``PIECE`` bytes, cut where no word is."""
    if len(text) <= PIECE:
        yield text
        return
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end]
        at = end


@dataclass
class _Work:
    """Words of some documents, ready to be hashed; the first ``carried`` of a part were counted with the one before."""

    words: list[bytes]
    spans: list[tuple[int, int, int]]  # row, words, carried
    size: int = 0


def _blocks(texts: list[bytes]) -> Iterator[_Work]:
    now = _Work([], [])
    for row, text in enumerate(texts):
        carried: list[bytes] = []
        for part in _pieces(text):
            own = carried + split_words(part)
            now.words += own
            now.spans.append((row, len(own), len(carried)))
            now.size += len(part)
            carried = own[-(RUN - 1) :]
            if now.size >= PIECE:
                yield now
                now = _Work([], [])
    if now.spans:
        yield now


def _states(words: list[bytes], head: Head) -> tuple[np.ndarray, ...]:
    """Head number (-1 in the tail), CRC, CRC with a blank before, and length of each word."""
    get = head.number.get
    number = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
    known = number >= 0
    state, spaced, length = (np.zeros(len(words), t) for t in (np.uint32, np.uint32, np.int64))
    for out, table in ((state, head.state), (spaced, head.spaced), (length, head.length)):
        out[known] = table[number[known]]
    tail = np.flatnonzero(~known)
    rare = [words[i] for i in tail]
    state[tail] = np.fromiter(map(zlib.crc32, rare), np.uint32, len(rare))
    space = zlib.crc32(b" ")
    spaced[tail] = np.fromiter((zlib.crc32(w, space) for w in rare), np.uint32, len(rare))
    length[tail] = np.fromiter(map(len, rare), np.int64, len(rare))
    return number, state, spaced, length


def _followed(state: np.ndarray, spaced: np.ndarray, length: np.ndarray, words: list[bytes]) -> np.ndarray:
    """States after a blank and the word that follows; ``words[i]`` follows ``state[i]``."""
    out = _moved(state, np.minimum(length, LONG) + 1) ^ spaced
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = zlib.crc32(b" " + words[i], int(state[i]))
    return out


def feature_buckets(work: _Work, head: Head) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: the place of each run's last word, and its bucket."""
    words, n = work.words, len(work.words)
    number, state, spaced, length = _states(words, head)
    spans = np.array(work.spans, np.int64).reshape(-1, 3)
    inside = np.arange(n) - np.repeat(np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1])
    carried = np.repeat(spans[:, 2], spans[:, 1])
    ends = lambda run: np.flatnonzero((inside >= run - 1) & (inside >= carried))
    one = ends(1)
    out = [(one, (state[one] % BUCKETS).astype(np.int64))]
    # A carried pair is needed for the run of three that goes on from it.
    last = np.flatnonzero(inside >= 1)
    pair, bucket = np.zeros(n, np.uint32), np.zeros(n, np.int64)
    short = lambda at: (number[at] >= 0) & (number[at] < len(head.pair_state))
    paired = short(last) & short(last - 1)
    both, rest = last[paired], last[~paired]
    pair[both] = head.pair_state[number[both - 1], number[both]]
    bucket[both] = head.pair_bucket[number[both - 1], number[both]]
    pair[rest] = _followed(state[rest - 1], spaced[rest], length[rest], _Picked(words, rest))
    bucket[rest] = pair[rest] % BUCKETS
    two = ends(2)
    out.append((two, bucket[two]))
    three = ends(3)
    triple = _followed(pair[three - 1], spaced[three], length[three], _Picked(words, three))
    return [*out, (three, (triple % BUCKETS).astype(np.int64))]


class _Picked:
    """``words[at[i]]`` without a copy of the list."""

    def __init__(self, words: list[bytes], at: np.ndarray) -> None:
        self.words, self.at = words, at

    def __getitem__(self, i: int) -> bytes:
        return self.words[self.at[i]]


def frequent_words(docs: DataFrame) -> list[bytes]:
    """About the ``HEAD`` most frequent words of all texts.

    A task counts its words and now and then lets go of the rarest, so its
    memory is bounded and words of a large share are never lost.
    """

    def work(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in small_batches(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for part in _pieces(text):
                    counts.update(split_words(part))
                    if len(counts) > 16 * HEAD:
                        counts = Counter(dict(counts.most_common(4 * HEAD)))
        best = [(w, n) for w, n in counts.most_common(HEAD) if len(w) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    counted = docs.select(text_of()).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(HEAD).collect()]


def bucket_totals(docs: DataFrame, head) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket; summed in the task first."""

    def work(batches: Batches) -> Batches:
        total = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches):
            for block in _blocks(batch.column(0).cast(pa.binary()).to_pylist()):
                for _, buckets in feature_buckets(block, head.value):
                    total += np.bincount(buckets, minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    return docs.select(text_of()).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, head) -> np.ndarray:
    """The gain of each bucket; only these ``BUCKETS`` numbers reach the driver."""
    spark = docs.sparkSession
    count = lambda df, name: bucket_totals(df, head).withColumnRenamed("n", name)
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").na.fill(0)
    both = cut_lineage(both, "bucket-totals")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(all_s + BUCKETS))) / ((s + 1) * F.lit(float(all_t + BUCKETS)))
    found = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``(doc_id, body, n_words, n_features, weight)`` of every row of ``docs``, written once."""
    context = docs.sparkSession.sparkContext
    head = context.broadcast(Head.of(frequent_words(docs)))
    gain = context.broadcast(gains(docs, target, head))

    def work(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for block in _blocks(batch.column(2).cast(pa.binary()).to_pylist()):
                row = np.repeat([s[0] for s in block.spans], [s[1] for s in block.spans])
                for run, (at, buckets) in enumerate(feature_buckets(block, head.value)):
                    own = np.bincount(row[at], minlength=batch.num_rows)
                    n += own
                    words += own if not run else 0
                    # Sums stay far below 2**53, so doubles are exact.
                    weight += np.bincount(row[at], gain.value[buckets], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words), pa.array(n), pa.array(weight)], _WEIGHTS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("body"), text_of())
    schema = ", ".join(f"{c} long" for c in _WEIGHTS)
    written = cut_lineage(rows.mapInArrow(work, schema), "importance-weights")
    head.destroy()
    gain.destroy()
    return written


_WEIGHTS = ["doc_id", "body", "n_words", "n_features", "weight"]


def with_scores(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise from the SHA-256 of ``seed:doc_id`` (nothing for a null id), in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))))


def draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """Adds ``rank``, from 1 by falling score, to the drawn ``percent`` of the rows of ``least_words`` words; null elsewhere.

    Ties go to the lesser id, none last, then to the text's hash. Rows per score
    are summed first: these sums give the score at which the draw ends, and only
    rows that reach it are sorted, in slices.
    """
    scored = cut_lineage(scored, "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    per_score = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    most = percent * able.count() // 100
    upto = running_total(per_score, ["all"], [F.desc("score")], "n", "scores")
    last = upto.where(F.col("before") < most).agg(F.min("score")).first()[0] if most else None
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select("*", none)
    reached = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), "body"]
    top = ranked(scored.where(reached).withColumn("all", F.lit(0)), ["all"], order, "draw").drop("all")
    rank = F.when(F.col("rank") <= most, F.col("rank").cast("long")).alias("rank")
    return top.select(*scored.columns, rank).unionByName(scored.where(~reached).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``(doc_id, body, n_words, n_features, weight, score, rank)`` of every row; ``rank`` numbers the draw.

    ``target`` needs a column ``text``; null texts have no words, and an empty
    target or table of documents is allowed. Texts are counted whole, long ones
    in parts that share their bordering words. Rows without an id share their
    noise, repeated rows count each. Other columns are not read.
    """
    return draw(with_scores(weights(docs, target), seed), percent, least_words)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs`` in its columns. Rows of one id and text stand or fall together."""
    doc, body = fresh(docs, "drawn_id"), fresh(docs, "drawn_body")
    own = resample(docs, target, percent, least_words, seed).where("rank IS NOT NULL")
    own = own.select(F.col("doc_id").alias(doc), F.col("body").alias(body)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(body))
    return docs.join(own, same, "left_semi")
