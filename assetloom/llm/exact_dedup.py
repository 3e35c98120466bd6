"""Exact dedup against a minimal perfect hash over the digests seen so far.

An index keeps one slot per distinct digest. Digests are dealt to shards by
their leading bits; a shard is one row, with a minimal perfect hash by levels of
bit arrays (Limasset et al., 2017) from digest to slot, and in each slot the
whole digest, how many rows had it and where the best of them is. A digest that
was never seen may hash to some slot, so the slot's bytes decide.

New rows meet their shard in pieces of bounded size. Repeats are folded onto
their slots, the others are grouped among themselves, and both change only the
shards they touch. Texts never move: rows of about 60 bytes stand for them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, keep_rows, text_of
from assetloom.session import cut_lineage

# Slots of a shard, and rows that one task looks up, on average at most.
SHARD_SLOTS, PIECE_ROWS = 1 << 15, 1 << 17
BLANK_RUN = "[\\x20\\x09-\\x0D]++"

_WORDS, _LOAD = 4, 2  # 64-bit words of a digest; bits of a level for each digest left
_SLOT = ["n", "chars", "doc_id", "place"]
_SHARD_SCHEMA = "shard long, sizes array<long>, bits binary, digests binary, " + ", ".join(f"{c} array<long>" for c in _SLOT)
_GROUP = ["digest", *_SLOT]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(words: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (_mixed(_mixed(words[:, 0] + seed) ^ words[:, 1]) % np.uint64(size)).astype(np.int64)


def as_words(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, _WORDS)


class PerfectHash:
    """From ``m`` distinct digests to the slots 0 to ``m - 1``; other digests get any slot or none."""

    def __init__(self, sizes: list[int], bits: bytes) -> None:
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1

    @staticmethod
    def build(words: np.ndarray) -> tuple[PerfectHash, bytes]:
        """Digests that are alone at their place take it; the rest try the next, smaller level."""
        sizes, levels, left = [], [], words
        while len(left):
            size = max(64, _LOAD * len(left))
            at = _spread(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.packbits(np.concatenate(levels or [np.zeros(0, bool)])).tobytes()
        return PerfectHash(sizes, bits), bits

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level holds it."""
        slot, left, offset = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = offset + _spread(words[left], level, size)
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left, offset = left[~hit], offset + size
        return slot


class _Shard:
    """One shard read back: slots in order, found by digest."""

    def __init__(self, row: pa.Table) -> None:
        self.hash = PerfectHash(row.column("sizes")[0].as_py(), row.column("bits")[0].as_py())
        self.words = np.frombuffer(row.column("digests")[0].as_py(), "<u8").reshape(-1, _WORDS)
        self.values = {c: row.column(c).combine_chunks().flatten() for c in _SLOT}

    def find(self, words: np.ndarray) -> np.ndarray:
        """Slots checked byte by byte; -1 for digests that are not there."""
        slot = self.hash.slots(words)
        at = np.flatnonzero(slot >= 0)
        slot[at[(self.words[slot[at]] != words[at]).any(1)]] = -1
        return slot


def _shard_rows(words: np.ndarray, values: dict[str, pa.Array], depth: int) -> list[pa.RecordBatch]:
    """Slots written as shards, one row each."""
    if not len(words):
        return []
    # The leading bits in the order of the digest's bytes.
    of = (words[:, 0].byteswap() >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(words), np.int64)
    out = []
    for shard in np.unique(of):
        own = np.flatnonzero(of == shard)
        made, bits = PerfectHash.build(words[own])
        own = own[np.argsort(made.slots(words[own]))]
        row = [pa.array([int(shard)]), pa.array([made.sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary())]
        row.append(pa.array([words[own].tobytes()], pa.binary()))
        for c in _SLOT:
            flat = values[c].take(pa.array(own))
            row.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        out.append(pa.RecordBatch.from_arrays(row, ["shard", "sizes", "bits", "digests", *_SLOT]))
    return out


def _empty_shards() -> pa.Table:
    longs = pa.list_(pa.int64())
    fields = [("shard", pa.int64()), ("sizes", longs), ("bits", pa.binary()), ("digests", pa.binary()), *((c, longs) for c in _SLOT)]
    return pa.schema(fields).empty_table()


def _split(batches: Batches, depth: int) -> Batches:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = _Shard(pa.Table.from_batches([batch.slice(i, 1)]))
            yield from _shard_rows(shard.words, shard.values, depth)


def _look_up(rows: pa.Table, shards: pa.Table) -> pa.Table:
    slot = np.full(rows.num_rows, -1, np.int64)
    values = {c: pa.array([], pa.int64()) for c in _SLOT}
    if rows.num_rows and shards.num_rows:
        shard = _Shard(shards.slice(0, 1))
        slot, values = shard.find(as_words(rows.column("digest"))), shard.values
    at = pa.array(slot, mask=slot < 0)
    found = [values[c].take(at) for c in _SLOT]
    return pa.Table.from_arrays([*rows.drop_columns(["shard", "piece"]).columns, *found], [*_ROW, *_FOUND])


def _change(shards: pa.Table, groups: pa.Table, depth: int) -> pa.Table:
    """A shard with the changed groups in place of their old slots, and the new ones added."""
    words, values = as_words(groups.column("digest")), {c: groups.column(c).combine_chunks() for c in _SLOT}
    if shards.num_rows:
        shard = _Shard(shards)
        slot = shard.find(words)
        stays = np.ones(len(shard.words), bool)
        stays[slot[slot >= 0]] = False
        words = np.concatenate([shard.words[stays], words])
        values = {c: pa.concat_arrays([shard.values[c].filter(pa.array(stays)), values[c]]) for c in _SLOT}
    made = _shard_rows(words, values, depth)
    return pa.Table.from_batches(made) if made else _empty_shards()


_ROW = ["doc_id", "body", "chars", "place", "digest"]
_FOUND = [f"slot_{c}" for c in _SLOT]
_ROW_SCHEMA = "doc_id long, body long, chars long, place long, digest binary"
_MET_SCHEMA = _ROW_SCHEMA + ", " + ", ".join(f"{c} long" for c in _FOUND)


def _best(prefix: str = "") -> Column:
    """Least where a row is to be kept: most code points, then the least id, none last, then its place."""
    chars, doc_id, place = (F.col(prefix + c) for c in ("chars", "doc_id", "place"))
    return F.struct((-chars).alias("less"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), place.alias("place"))


def text_rows(docs: DataFrame) -> DataFrame:
    """A written row per document: id, hash of the text, code points, place in this table, digest without blanks.

    The digest is the SHA-256 of the text without the characters U+0020 and
    U+0009 to U+000D. A null text is read as the empty one.
    """
    bare = F.regexp_replace(text_of(), BLANK_RUN, "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_of()).alias("body"),
        F.char_length(text_of()).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("place"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
    )
    return cut_lineage(rows, "text-rows")


@dataclass(frozen=True)
class Index:
    """What has been seen: ``shards`` of slots, named by the first ``depth`` bits of a digest."""

    shards: DataFrame
    depth: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Index:
        return Index(spark.createDataFrame([], _SHARD_SCHEMA))

    def _shard_of(self) -> Column:
        first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        return F.shiftright(first, 32 - self.depth) if self.depth else F.lit(0).cast("long")

    def entries(self) -> DataFrame:
        """``(digest, n, chars, doc_id, place)`` of every slot."""
        slot = F.explode(F.arrays_zip(*_SLOT, F.sequence(F.lit(0), F.size("n") - 1).alias("at"))).alias("s")
        read = self.shards.select("digests", slot)
        return read.select(F.substr("digests", F.col("s.at") * 32 + 1, F.lit(32)).alias("digest"), *[f"s.{c}" for c in _SLOT])

    def look_up(self, rows: DataFrame) -> DataFrame:
        """``rows`` (as ``text_rows`` gives them) with the slot of their digest, nulls where there is none.

        A digest with a large share of all rows makes its shard a busy one: the
        rows of a shard are dealt to as many tasks as ``PIECE_ROWS`` asks for,
        and each of these reads the shard.
        """
        named = rows.select(self._shard_of().alias("shard"), *_ROW)
        counts = named.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("pieces"))
        counts = cut_lineage(counts, "shard-rows")
        dealt = named.join(counts, "shard").withColumn("piece", F.pmod(F.xxhash64("place"), "pieces")).drop("pieces")
        copies = self.shards.join(counts, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        met = dealt.groupBy("shard", "piece").cogroup(copies.drop("pieces").groupBy("shard", "piece"))
        return met.applyInArrow(_look_up, _MET_SCHEMA)

    def _split_to(self, depth: int) -> Index:
        if depth <= self.depth:
            return self
        return Index(self.shards.mapInArrow(partial(_split, depth=depth), _SHARD_SCHEMA), depth)

    def with_rows(self, rows: DataFrame) -> Index:
        """The index after ``rows``: repeats counted on their slots, whose best row may change, the others added.

        Groups are folded before they are shuffled. Shards that nothing
        changes are copied as they are.
        """
        met = cut_lineage(self.look_up(rows), "met-rows")
        folded = lambda df, *more: df.groupBy("digest", *more).agg(F.count(F.lit(1)).alias("n"), F.min(_best()).alias("best"))
        repeats = folded(met.where(F.col("slot_n").isNotNull()), *_FOUND)
        grown = repeats.select("digest", (F.col("n") + F.col("slot_n")).alias("n"), F.least("best", _best("slot_")).alias("best"))
        new = folded(met.where(F.col("slot_n").isNull()))
        best = [(-F.col("best.less")).alias("chars"), F.col("best.doc_id").alias("doc_id"), F.col("best.place").alias("place")]
        groups = cut_lineage(grown.unionByName(new).select("digest", "n", *best), "changed-groups")
        slots = groups.count() + (self.shards.agg(F.sum(F.size("n"))).first()[0] or 0)
        depth = max(self.depth, (slots // SHARD_SLOTS).bit_length())
        old = self._split_to(depth)
        keyed = groups.select(old._shard_of().alias("shard"), *_GROUP)
        made = old.shards.groupBy("shard").cogroup(keyed.groupBy("shard"))
        return Index(cut_lineage(made.applyInArrow(partial(_change, depth=depth), _SHARD_SCHEMA), "index"), depth)


def place_rows(rows: DataFrame, index: Index) -> DataFrame:
    """``(doc_id, body, place, digest, keep_id, keep_place, group_size, kept)`` of rows the index holds."""
    found = index.look_up(rows)
    kept = (F.col("place") == F.col("keep_place")).alias("kept")
    named = found.select(
        "doc_id", "body", "place", "digest", F.col("slot_doc_id").alias("keep_id"),
        F.col("slot_place").alias("keep_place"), F.col("slot_n").alias("group_size"),
    )
    return named.select("*", kept)


def duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``place_rows`` for every row of ``docs``.

    The table is read in two instalments, by a bit of a hash of id and place: the
    second meets what the first has left in the index. Of equal texts (blanks
    aside) the row with the most code points in the original stays, then that of
    the least id; rows without an id come last, and of rows alike in all of this
    exactly one stays. Null, empty and blank texts are equal. Texts are whole
    whatever their length, other columns are not read, and a table without rows
    gives none.
    """
    rows = text_rows(docs)
    second = F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("place")).bitwiseAND(1) == 1
    index = Index.empty(docs.sparkSession).with_rows(rows.where(~second))
    return place_rows(rows, index.with_rows(rows.where(second)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, in its columns, whatever their names."""
    placed = cut_lineage(duplicates(docs).select("doc_id", "body", "kept"), "placed-rows")
    return keep_rows(docs, placed, placed.where("kept").select("doc_id", "body"))
