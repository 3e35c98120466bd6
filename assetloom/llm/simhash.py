"""SimHash near-dedup by covering locality-sensitive hashing (Pagh, 2016).

Fingerprints within the radius collide in at least one of ``2**(radius + 1) - 1``
tables, so no link is missed. Buckets that are large are hashed again on their
free bits, which bounds what a task compares without dropping anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, keep_rows, runs, small_batches, text_of, whole_runs
from assetloom.llm.components import connected_components
from assetloom.session import cut_lineage

SEED, SHINGLE, RADIUS, BITS = 42, 3, 2, 64
# Buckets of more distinct fingerprints are hashed a second time.
LARGE = 4096
_HASHES_AT_ONCE = 1 << 18


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one whole text in UTF-8, 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES_AT_ONCE):
        pairs = zip(first[at : at + _HASHES_AT_ONCE], last[at : at + _HASHES_AT_ONCE], strict=True)
        h = np.array([digest(whole[a:b], SEED) for a, b in pairs], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, fp)`` of every row, ``fp`` as a signed 64-bit integer. A null text has no words."""

    def work(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)], ["doc_id", "body", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of())
    return rows.mapInArrow(work, "doc_id long, body long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the bit positions ``bits``: any ``radius`` positions are all unset in some mask.

    Positions are dealt evenly to the nonzero vectors of a binary space of
    ``radius + 1`` dimensions. The mask of vector ``v`` holds the positions whose
    vector has odd overlap with it. Fewer vectors than dimensions always leave
    some ``v`` that is orthogonal to all of them.
    """
    size = 2 ** (radius + 1)
    return [
        sum(1 << bit for i, bit in enumerate(bits) if ((i % (size - 1) + 1) & v).bit_count() % 2) for v in range(1, size)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables() -> tuple[list[int], list[list[int]]]:
    """First masks, and for each the masks that also hold half of its free bits."""
    first = covering_masks(list(range(BITS)), RADIUS)
    second = [[m | x for x in covering_masks([b for b in range(BITS) if not m >> b & 1], RADIUS)] for m in first]
    return first, second


def _close(table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket a set of verified links that ties together what links within it tie together."""
    fp = table.column("fp").to_numpy()
    bits = fp.view(np.uint64)
    starts = runs([table.column("t").to_numpy(), table.column("k").to_numpy()])
    lengths = np.diff(starts)
    left, right = [], []
    short = np.repeat(lengths <= 16, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for step in range(1, 16):
        if len(fp) <= step:
            break
        near = (owner[step:] == owner[:-step]) & short[step:] & (np.bitwise_count(bits[step:] ^ bits[:-step]) <= radius)
        at = np.flatnonzero(near)
        left.append(fp[at])
        right.append(fp[at + step])
    for b in np.flatnonzero(lengths > 16):
        own = bits[starts[b] : starts[b + 1]]
        names = fp[starts[b] : starts[b + 1]]
        waiting = np.arange(len(own))
        front = waiting[:0]
        while len(waiting):
            if not len(front):
                front, waiting = waiting[:1], waiting[1:]
            some, front = front[:256], front[256:]
            near = np.bitwise_count(own[some, None] ^ own[None, waiting]) <= radius
            hit = near.any(0)
            left.append(names[some[near.argmax(0)[hit]]])
            right.append(names[waiting[hit]])
            front, waiting = np.concatenate([front, waiting[hit]]), waiting[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: verified links between the distinct ``fp``, enough to tie every class together."""
    first, second = _tables()
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(first)])
    dealt = fps.select("fp", F.explode(masks).alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("k"))
    # Most fingerprints are alone in their bucket; only buckets with company go on.
    company = dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(dealt.join(cut_lineage(company, "simhash-buckets"), ["t", "k"]), "simhash-company")
    again = F.array(
        *[F.array(*[F.struct(F.lit(100 + 10 * t + i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(row)])
          for t, row in enumerate(second)]
    )
    large = met.where(F.col("n") > LARGE).select("fp", F.explode(F.get(again, F.col("t"))).alias("x"))
    large = large.select("x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("k"), "fp")
    buckets = met.where(F.col("n") <= LARGE).select("t", "k", "fp").union(large)

    def work(batches: Batches) -> Batches:
        for part in whole_runs(batches, ["t", "k"]):
            a, b = _close(part, RADIUS)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, fp, component, component_id)`` for every row of ``docs``.

    Fingerprints that differ in two bits or fewer are linked; ``component`` is
    the least fingerprint and ``component_id`` the least ``doc_id`` reachable,
    null if no document there has an id. ``body`` tells texts of one id apart.
    Copies meet as one fingerprint, so a large group costs one row per table.
    Texts are read whole however long, other columns not at all; an empty table
    gives no rows.
    """
    prints = cut_lineage(with_fingerprints(docs), "simhash-docs")
    fps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    found = connected_components(links(fps.select("fp")), "simhash-links")
    placed = fps.join(found, fps["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(placed.join(named, "component").select("fp", "component", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "body", "fp", "component", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component in the columns of ``docs``: of its least id, the text with the least hash.

    Repeated rows are reduced to one. Rows without an id stay only where their
    component has no id at all.
    """
    return least_rows(docs, near_duplicates(docs))


def least_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows that ``keep_one`` keeps, from the components ``near_duplicates`` gives."""
    rows = cut_lineage(placed.select("doc_id", "body", "component", "component_id"), "simhash-placed")
    found = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("component").agg(F.first("component_id").alias("doc_id"), F.min("body").alias("body"))
    return keep_rows(docs, rows, first)
