"""Benchmark decontamination by spaced seeds.

Fixed masks over windows of words ignore some positions, so a changed word need
not hide a copied passage. Test windows and text windows with equal hashes are
joined; around each hit, the overlap is compared word by word, changed words
allowed.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, fresh, small_batches, text_of
from assetloom.session import cut_lineage

# Fixed seeds ("1": compared, "0": ignored) with the least and most words of the items they are for. In an item of any
# length, however a fifth of its words are changed, one seed at one place is left whole (tests/llm prove it).
MOST_WORDS = 1 << 62
SEEDS = (
    *(("1" * n, n, n) for n in range(1, 5)),
    *((x, 5, 10) for x in ("1111", "11011", "11101", "10111")),
    *((x, 11, 20) for x in ("1111011", "10011111", "101111001", "1001001111", "1110100011")),
    *((x, 21, MOST_WORDS) for x in ("11111011", "101101111", "1110100111", "10001011111", "10101010111", "11101100011")),
)
LEAST_SHARE = 0.8  # of the words of a test item found in place
LONG_OVERLAP = 50  # words found in place that count whatever their share
LEAST_RUN = 5  # an overlap has at least so many words
BLOCK_WORDS = 1 << 18  # words of test items that a task holds at once: at most 48 MB of tables
MOST_FILTER_BITS = 28  # a filter of 32 MB at most goes to the tasks
_WORD = re.compile(r"\w+")
_GAP = [0] * max(len(x) for x, _, _ in SEEDS)  # between texts, so that no window spans two
_FILTER_BITS = 20
_COMPARED_AT_ONCE = 1 << 20
_WORDS_KNOWN = 1 << 18


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def seed_hashes(values: np.ndarray, seed: str) -> np.ndarray:
    """The hash of each window of word values, its ignored positions left out.

    A sum of random values times odd numbers of their own, modulo 2**64.
    """
    n = len(values) - len(seed) + 1
    out = np.zeros(max(0, n), np.uint64)
    for i, mark in enumerate(seed):
        if mark == "1" and n > 0:
            out += values[i : i + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1)
    return out


class _Table:
    """Hashes of one seed over the items, with the item and place of each; most lookups end at the filter."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of (position in ``h``, item, place in the item)."""
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        low = np.searchsorted(self.hashes, h[at])
        count = np.searchsorted(self.hashes, h[at], "right") - low
        rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.stack([np.repeat(at, count), self.owner[rows], self.place[rows]], 1)


class Probe:
    """The seed tables of one bounded block of test items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [(key, np.array([number(w) for w in words_of(text)], np.int64)) for key, text in items]
        self.values = np.random.default_rng(7).integers(0, 2**64, len(self.vocabulary) + 1, np.uint64)
        every = [(i, ids, np.arange(len(ids))) for i, (_, ids) in enumerate(self.items)]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.tables = []
        for seed, least, most in SEEDS:
            some = [x for x in every if least <= len(x[1]) <= most]
            hashes = [seed_hashes(self.values[ids], seed) for _, ids, _ in some]
            owner = join([np.full(len(h), i) for h, (i, _, _) in zip(hashes, some, strict=True)])
            place = join([places[: len(h)] for h, (_, _, places) in zip(hashes, some, strict=True)])
            self.tables.append(_Table(np.concatenate([np.zeros(0, np.uint64), *hashes]), owner, place))
        self.lengths = np.array([len(ids) for _, ids, _ in every], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = join([ids for _, ids, _ in every])

    def _hits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct rows of (position of the item's first word if in place, item, number of the text that was hit)."""
        values = self.values[ids]
        found = [np.zeros((0, 3), np.int64)]
        for (seed, _, _), table in zip(SEEDS, self.tables, strict=True):
            if not len(table.hashes):
                continue
            rows = table.find(seed_hashes(values, seed))
            found.append(np.stack([rows[:, 0] - rows[:, 2], rows[:, 1], rows[:, 0]], 1))
        rows = np.concatenate(found)
        rows[:, 2] = np.searchsorted(starts, rows[:, 2], "right") - 1
        # One number a row sorts faster than three.
        most, n = int(self.lengths.max(initial=0)), len(self.items)
        keys = np.unique(((rows[:, 0] + most) * len(starts) + rows[:, 2]) * n + rows[:, 1])
        rows = np.stack([keys // n // len(starts) - most, keys % n, keys // n % len(starts)], 1) if n else rows
        return rows[self._worth(ids, starts, rows)]

    def _worth(self, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether a hit has the equal words that any overlap has; most hits of light seeds have not."""
        start, i, t = rows.T
        first = np.maximum(start, starts[t])
        size = np.minimum(start + self.lengths[i], starts[t + 1] - len(_GAP)) - first
        same = np.zeros(len(rows), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + _COMPARED_AT_ONCE, "right")))
            n, base = size[at:to], ends[at:to] - size[at:to]
            step = np.arange(n.sum()) - np.repeat(base - base[0], n)
            text = ids[np.repeat(first[at:to], n) + step]
            own = self.flat[np.repeat(self.offsets[i[at:to]] + first[at:to] - start[at:to], n) + step]
            same[at:to] = np.add.reduceat(text == own, base - base[0], dtype=np.int64)
            at = to
        return same >= np.minimum(LEAST_RUN, np.ceil(LEAST_SHARE * self.lengths[i] - 1e-9))

    def overlaps(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item key, words of the item found, words of the item, position of the first in the text)."""
        get, flat, starts = self.vocabulary.get, [], [0]
        for text in texts:
            flat += [get(w, 0) for w in words_of(text)]
            flat += _GAP
            starts.append(len(flat))
        ids = np.array(flat, np.int64)
        covered: list[dict[int, tuple[np.ndarray, int]]] = [{} for _ in texts]
        for start, i, t in self._hits(ids, np.array(starts)).tolist():
            own, low, high = self.items[i][1], starts[t], starts[t + 1] - len(_GAP)
            a, b = max(0, low - start), min(len(own), high - start)
            same = own[a:b] == ids[start + a : start + b]
            held = same if _enough(same.sum(), len(own)) else _runs_of(same)
            if held.any():
                mask, first = covered[t].get(i, (np.zeros(len(own), bool), high))
                mask[a:b] |= held
                covered[t][i] = (mask, min(first, start + a + int(held.argmax())))
        return [
            [
                (self.items[i][0], int(mask.sum()), len(mask), first - starts[t])
                for i, (mask, first) in sorted(found.items())
                if mask.sum() >= LONG_OVERLAP or _enough(mask.sum(), len(mask))
            ]
            for t, found in enumerate(covered)
        ]


def _enough(found: int, size: int) -> bool:
    return found >= LEAST_SHARE * size - 1e-9


def _runs_of(same: np.ndarray) -> np.ndarray:
    """Equal words of stretches in which at most every fifth word differs and ``LEAST_RUN`` are equal.

    Around an equal word, equal ones are counted among the nine words nearest to
    it, or the fewer that there are at an end; this lets single changed words
    pass and cuts stretches of chance equality. It bounds what counts towards
    ``LONG_OVERLAP`` and what several alignments add up to; an alignment that
    holds the share by itself counts whole, wherever its changed words are.
    """
    least = min(LEAST_RUN, len(same))
    sums = np.concatenate([[0], np.cumsum(same)])
    at = np.arange(len(same))
    low, high = np.maximum(0, at - 4), np.minimum(len(same), at + 5)
    dense = (sums[high] - sums[low]) >= np.minimum(least, 4 * (high - low) // 5)
    return same & dense


def _items(benchmark: DataFrame) -> DataFrame:
    """The test items, written and numbered, with the words they count for; items of long words count by bytes."""
    words = F.greatest(F.regexp_count("text", F.lit(r"(?U)\w+")).cast("long"), F.octet_length("text").cast("long") / 32)
    own = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text"))
    own = own.select("item_id", "text", words.alias("words"), F.monotonically_increasing_id().alias("number"))
    return cut_lineage(own.where("text != ''"), "test-items")


def _one_block(items: DataFrame) -> Probe | None:
    """The tables of all items where they fit one block, to be copied to the tasks."""
    if (items.agg(F.sum("words")).first()[0] or 0) > BLOCK_WORDS:
        return None
    return Probe([(x.item_id, x.text) for x in items.orderBy("item_id", "text").collect()])


class _WordValues(dict):
    """A 64-bit value for each word, alike in all tasks; a bounded number is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _seed_rows(batches: Batches) -> Batches:
    values = _WordValues()
    for batch in small_batches(batches):
        numbers, texts = (c.to_pylist() for c in batch.columns)
        for number, text in zip(numbers, texts, strict=True):
            own = np.array([values[w] for w in words_of(text)], np.uint64)
            for i, (seed, least, most) in enumerate(SEEDS):
                if least <= len(own) <= most:
                    distinct = np.unique(seed_hashes(own, seed)).view(np.int64)
                    columns = [np.full(len(distinct), i), distinct, np.full(len(distinct), number)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seed", "seed_hash", "number"])


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """Two bits for each hash, named by its first and its next bits, of 64 or more for each until the filter is as large as it may be."""
    bits = min(MOST_FILTER_BITS, max(_FILTER_BITS, (64 * seeds.count()).bit_length()))
    places = [F.shiftrightunsigned(h, 64 - bits) + 1 for h in (F.col("seed_hash"), F.shiftleft("seed_hash", bits))]
    at = F.col("at")
    parts = seeds.select(F.explode(F.array(*places)).alias("at")).groupBy(F.bitmap_bucket_number(at).alias("part"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, own in parts.collect():
        out[(part - 1) * len(own) : part * len(own)] = np.frombuffer(own, np.uint8)
    return out


def _passing(hashes: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Where hashes stand whose two bits are both set."""
    bits = len(filled).bit_length() + 2
    at = np.arange(len(hashes))
    for skipped in (0, bits):
        place = (hashes[at] << np.uint64(skipped)) >> np.uint64(64 - bits)
        at = at[((filled[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).view(bool)]
    return at


def _hits(batches: Batches, filled: np.ndarray, used: list[str]) -> Batches:
    """``(doc_id, body, seed_hash)``: hashes of a text's windows that pass the filter, each once."""
    values = _WordValues()
    for batch in small_batches(batches):
        flat, starts = [], [0]
        for text in batch.column(2).to_pylist():
            flat += [values[w] for w in words_of(text)]
            flat += _GAP
            starts.append(len(flat))
        flat = np.array(flat, np.uint64)
        found = [np.zeros((0, 2), np.int64)]
        for seed in used:
            hashes = seed_hashes(flat, seed)
            at = _passing(hashes, filled)
            found.append(np.stack([np.searchsorted(starts, at, "right") - 1, hashes[at].view(np.int64)], 1))
        rows = np.unique(np.concatenate(found), axis=0)
        of = pa.array(rows[:, 0])
        columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(rows[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "seed_hash"])


_FOUND = ["item_id", "n_found", "n_words", "first_word"]
_FOUND_SCHEMA = "doc_id long, body long, " + ", ".join(f"{c} long" for c in _FOUND)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "body", *_FOUND])


def _verify(batches: Batches) -> Batches:
    """Texts with the items they may hold: the overlaps, compared word by word."""
    for batch in small_batches(batches):
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for doc_id, body, text, items in rows:
            own = Probe([(x["item_id"], x["text"]) for x in items]).overlaps([text])[0]
            yield _found_batch([(doc_id, body, *x) for x in own])


def _copied(batches: Batches, probe: Probe) -> Batches:
    for batch in small_batches(batches):
        ids, bodies, texts = (c.to_pylist() for c in batch.columns)
        found = zip(ids, bodies, probe.overlaps(texts), strict=True)
        yield _found_batch([(d, b, *x) for d, b, own in found for x in own])


def _joined(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps by a shuffled join of hashes, for items of any number.

    Only hashes that pass a filter of bounded size meet those of the items. The
    items a text may hold are gathered in blocks, by a hash of their number, so
    that a list holds about ``BLOCK_WORDS`` words at most; texts that met no item
    drop out by the join of keys.
    """
    made = items.select("number", "text").mapInArrow(_seed_rows, "seed long, seed_hash long, number long")
    seeds = cut_lineage(made, "item-seeds")
    used = list(dict.fromkeys(SEEDS[x.seed][0] for x in seeds.select("seed").distinct().collect()))
    hits = keyed.mapInArrow(partial(_hits, filled=_filter_of(seeds), used=used), "doc_id long, body long, seed_hash long")
    pairs = cut_lineage(hits.join(seeds, "seed_hash").select("doc_id", "body", "number").distinct(), "texts-and-items")
    blocks = items.agg(F.ceil(F.sum("words") / BLOCK_WORDS)).first()[0]
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block")
    gathered = pairs.join(items, "number").groupBy(F.col("doc_id").alias("doc"), F.col("body").alias("hash"), block)
    lists = cut_lineage(gathered.agg(F.collect_list(F.struct("item_id", "text")).alias("items")).drop("block"), "texts-items")
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("body") == F.col("hash"))
    return keyed.join(lists, same).select("doc_id", "body", "text", "items").mapInArrow(_verify, _FOUND_SCHEMA)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("body"), text_of().alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_found, n_words, first_word)``: documents that hold a test item.

    A row is given when at least 0.8 of the item's words, or 50 of them, stand
    in the document in the item's order, changed words allowed between them. Each
    document is judged whole. Words are runs of letters, digits and underscores,
    lower-cased. Null texts and items without words hold nothing. An item in
    place is found wherever its changed words are, up to a fifth of them. A
    passage with words added or left out counts by its dense stretches, so one
    that has changed words close together as well can be missed. Repeated rows
    give repeated results, a null id stays null, other columns are not read, and
    a table without rows gives none. Texts are met whole whatever their length,
    several to a lookup.

    Items of up to ``BLOCK_WORDS`` words in all are copied to the tasks, so
    neither texts nor hashes move. More items meet the texts by a shuffled join
    of hashes, with the same rows; only the filter passes the driver.
    """
    items = _items(benchmark)
    probe = _one_block(items)
    keyed = _keyed(docs)
    found = keyed.mapInArrow(partial(_copied, probe=probe), _FOUND_SCHEMA) if probe else _joined(keyed, items)
    return found.select("doc_id", *_FOUND)


def _clean(batches: Batches, probe: Probe, column: int) -> Batches:
    for batch in small_batches(batches):
        texts = batch.column(column).cast(pa.string()).fill_null("").to_pylist()
        yield batch.filter(pa.array([not own for own in probe.overlaps(texts)], pa.bool_()))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept, whatever their names.

    Found as in ``contaminated``. Nothing is shuffled where the items are copied;
    otherwise the rows meet the ids and text hashes of those that go.
    """
    items = _items(benchmark)
    probe = _one_block(items)
    if probe:
        return docs.mapInArrow(partial(_clean, probe=probe, column=docs.columns.index("text")), docs.schema)
    doc, body = fresh(docs, "gone_id"), fresh(docs, "gone_body")
    gone = _joined(_keyed(docs), items).select(F.col("doc_id").alias(doc), F.col("body").alias(body)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(body))
    return docs.join(cut_lineage(gone, "gone-keys"), same, "left_anti")
