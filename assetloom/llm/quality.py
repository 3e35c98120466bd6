"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of a text. Its covariance
is shrunk towards the pooled one and towards a multiple of the identity. The
score is the logistic of the difference of the two log-densities (Mahalanobis
distances by cached inverse Cholesky factors) plus the log-odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, small_batches, text_of
from assetloom.session import cut_lineage

# Shares are smoothed by this much before their logarithm is taken.
SMOOTH = 1e-3
STATISTICS = (
    "log_length", "upper", "digit", "symbol", "mark", "stop", "other_byte", "blank", "new_line", "longest_line",
    "mean_word", "spread_word", "short_word", "distinct_word", "distinct_line", "mark_word", "upper_word",
)
EVIDENCE = 200  # bytes at which a text's statistics weigh half
MOST_LABELS = 50_000  # labelled rows that a model is fitted to where their statistics are not at hand
GROUPS = 256  # moments of many tasks are first summed in so many groups

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, list(b".,;:'\"-"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOP
_MARK = np.isin(_BYTES, list(b"!?|#*$%&"))
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _MARK, _STOP, _BYTES >= 128, _BLANK, _BYTES == 10]).astype(np.float64)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text in UTF-8; defined for empty texts too."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    shares = np.log(_CLASSES @ counts / n + SMOOTH)
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    count = max(1, len(words))
    marked = sum(1 for w in words if w[-1] not in b".,;:" and w[-1] < 128 and not (w[-1:].isalnum()))
    upper = sum(map(bytes.isupper, words))
    return [
        np.log1p(len(text)),
        *shares,
        np.log(max(map(len, lines)) / n + SMOOTH),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log((lengths <= 3).mean() + SMOOTH),
        # Distinct words grow with a power of the length; this ratio of logarithms hardly depends on it.
        np.log(max(2, len(set(words)))) / np.log(max(2, count)),
        np.log(len(set(lines)) / len(lines)),
        np.log(marked / count + SMOOTH),
        np.log(upper / count + SMOOTH),
    ]


def _measure(texts: pa.Array) -> np.ndarray:
    found = [statistics(t) for t in texts.cast(pa.binary()).to_pylist()]
    return np.array(found, np.float64).reshape(len(found), len(STATISTICS))


def _as_lists(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values, np.float64)
    ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, x)``: the statistics of every row's whole text, however long; no row for an empty table."""

    def work(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_lists(_measure(batch.column(1)))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), text_of(text)).mapInArrow(work, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """A fitted model; small, so it travels with the task. Without two classes only the prior speaks."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray  # inverse Cholesky factors, one per class
    log_det: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        z = standard(x, self.center, self.scale)
        density = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_det, strict=True):
            away = (z - mean) @ whiten.T
            density.append(-0.5 * (np.einsum("ij,ij->i", away, away) + log_det))
        logit = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-logit))


def standard(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores without the length, which is no mark of quality.

    Statistics of a short text are mostly chance: they are drawn to the mean by
    the length over the length plus ``EVIDENCE``. Far tails, which a Gaussian
    would overrate, are drawn in.
    """
    length = np.expm1(x[:, :1])
    return np.arcsinh((x[:, 1:] - center[1:]) / scale[1:] * (length / (length + EVIDENCE)))


def _moments(x: DataFrame, view, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products per class: per batch, then in groups, then in all."""
    schema = "cls int, part int, n double, s array<double>, p array<double>"

    def rows(found: dict) -> pa.RecordBatch:
        keys = sorted(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([float(found[k][0]) for k in keys]), _as_lists(np.array([found[k][1] for k in keys])),
                _as_lists(np.array([found[k][2].ravel() for k in keys])),
            ],
            ["cls", "part", "n", "s", "p"],
        )

    def first(batches: Batches) -> Batches:
        found: dict = {}
        part = None
        for batch in batches:
            part = batch.column(2)[0].as_py() if part is None and batch.num_rows else part
            values = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            labels = np.asarray(batch.column(0))
            z = view(values)
            for cls in np.unique(labels):
                own = z[labels == cls]
                n, s, p = found.get((cls, part), (0, 0, 0))
                found[(cls, part)] = (n + len(own), s + own.sum(0), p + own.T @ own)
        if found:
            yield rows(found)

    def merge(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy().sum()
        s = np.array(group.column("s").to_pylist()).sum(0)
        p = np.array(group.column("p").to_pylist()).sum(0)
        key = (group.column("cls")[0].as_py(), group.column("part")[0].as_py())
        return pa.Table.from_batches([rows({key: (n, s, p)})])

    dealt = x.select("cls", "x", (F.spark_partition_id() % GROUPS).alias("part"))
    sums = dealt.mapInArrow(first, schema).groupBy("cls", "part").applyInArrow(merge, schema)
    total = sums.withColumn("part", F.lit(0)).groupBy("cls", "part").applyInArrow(merge, schema)
    return {r.cls: (r.n, np.array(r.s), np.array(r.p).reshape(width, width)) for r in total.collect()}


def fit(x: DataFrame, labels: DataFrame, pooled: float = 0.2, ridge: float = 0.05) -> Discriminant:
    """Fit to every labelled row. ``pooled`` and ``ridge`` are the two shrinkages.

    ``x`` holds ``(doc_id, x)``, ``labels`` holds ``(doc_id, quality)`` with 0 or
    1; other labels are left out and repeated rows count each. Only moments (a
    number fixed by the statistics) reach the driver.
    """
    width = len(STATISTICS)
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("cls"))
    known = cut_lineage(x.join(marked, "doc_id").select("cls", "x"), "quality-train")
    raw = _moments(known, lambda v: v, width)
    n = {k: raw[k][0] if k in raw else 0.0 for k in (0, 1)}
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n.values()) < 2:
        none = np.zeros((0, width))
        return Discriminant(np.zeros(width), np.ones(width), none, none, none, log_odds)
    total = n[0] + n[1]
    center = (raw[0][1] + raw[1][1]) / total
    variance = np.diag(raw[0][2] + raw[1][2]) / total - center**2
    scale = np.sqrt(np.maximum(variance, 1e-6))
    z = _moments(known, lambda v: standard(v, center, scale), width - 1)
    means = np.array([z[k][1] / z[k][0] for k in (0, 1)])
    own = [z[k][2] / z[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    common = (own[0] * n[0] + own[1] * n[1]) / total
    whiten, log_det = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * own[k] + pooled * common
        shrunk = (1 - ridge) * shrunk + (ridge * np.trace(shrunk) / len(shrunk) + 1e-9) * np.eye(len(shrunk))
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(center, scale, means, np.array(whiten), np.array(log_det), log_odds)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, x: DataFrame | None = None, most: int = MOST_LABELS) -> Discriminant:
    """Fit on the labels of ids that are not held out.

    With the statistics ``x`` of all documents at hand, on every such label.
    Without, on about ``most`` of them at most, chosen by a hash of the id, and
    only these documents are measured: 17 statistics need no more.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1))
    if x is None:
        share = min(1.0, most / max(1, known.count()))
        known = cut_lineage(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "quality"), "quality-labels")
        x = with_statistics(docs.join(known.select("doc_id").distinct(), "doc_id", "left_semi"))
    return fit(x, known)


def score_statistics(x: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` from ``(doc_id, x)``."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], ["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(work, "doc_id long, score double")


def _keep(batches: Batches, model: Discriminant, least: float, column: str) -> Batches:
    for batch in small_batches(batches):
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.string()).fill_null("")
        yield batch.filter(pa.array(model.score(_measure(texts)) >= least))


def filter_quality(docs: DataFrame, model: Discriminant, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns kept and no text shuffled.

    A null text scores as the empty text; ids, nulls and repeated rows do not
    matter, since each row is judged by its text alone, read whole. An empty
    table gives no rows.
    """
    return docs.mapInArrow(partial(_keep, model=model, least=least, column="text"), docs.schema)
