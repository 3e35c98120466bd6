"""Chat formatting at the level of tokens.

Roles and texts are encoded as segments of their own and spliced with reserved
ids, so no text can ever produce a mark. In the rendered string, where marks are
text, control strings that occur in a content are escaped reversibly. The loss
mask is the prefix sum of openings and closings of the segments learned from.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, as_lists, flat_lists, small_batches, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 14  # longer segments are encoded in pieces
# A word never goes on here, whatever comes before and behind.
_CUT = re.compile(r"(?<=\S) ")


@dataclass(frozen=True)
class Template:
    """``begin``, then for each turn ``turn`` role ``text`` content ``close``.

    ``others`` are control strings of other templates, escaped as well. No
    control string may hold its first character twice, start another or hold
    the escape; then escaping can be undone exactly.
    """

    begin: str = "<s>"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    close: str = "</s>"
    others: tuple[str, ...] = (
        "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>",
    )
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or self.escape in c or heads & set(c[1:]):
                raise ValueError(f"control string {c!r} cannot be escaped reversibly")
            if any(o != c and o.startswith(c) for o in self.controls):
                raise ValueError(f"control string {c!r} starts another")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.turn, self.text, self.close)

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.marks, *self.others)))

    def _pattern(self, escapes: str) -> re.Pattern:
        heads: dict[str, list[str]] = {}
        for c in self.controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        e = re.escape(self.escape)
        return re.compile("|".join(f"(?<={re.escape(h)}){escapes}(?={e}*(?:{'|'.join(t)}))" for h, t in heads.items()))

    def escaped(self, text: str) -> str:
        """One escape more after the head of every control string, with or without escapes already."""
        return _compiled(self)[0].sub(lambda _: self.escape, text)

    def unescaped(self, text: str) -> str:
        return _compiled(self)[1].sub("", text)


@lru_cache
def _compiled(template: Template) -> tuple[re.Pattern, re.Pattern]:
    return template._pattern(""), template._pattern(re.escape(template.escape))


class Codec:
    """A byte-level tokenizer and the ids reserved after its vocabulary, one per mark."""

    def __init__(self, vocabulary: str, template: Template) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(vocabulary)
        with fs.open_input_stream(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.base = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.template, self.first = template, max(ranks.values()) + 1

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text. A long one is cut where a blank follows a mark, as words always are there."""
        ids, at = [], 0
        while len(text) - at > PIECE:
            cut = next((m.start() for m in _CUT.finditer(text, at + PIECE // 2)), len(text))
            ids += self.base.encode_ordinary(text[at:cut]) if cut - at <= 2 * PIECE else self._stretch(text, at, cut)
            at = cut
        return ids + self.base.encode_ordinary(text[at:])

    def _stretch(self, text: str, start: int, end: int) -> list[int]:
        """Text without a place to cut: its words one by one, as long runs overflow the tokenizer's own stack."""
        words = (m[0] for m in regex.finditer(PATTERN, text, pos=start, endpos=end))
        return [i for word in words for i in self.base._encode_single_piece(word)]

    def decode(self, ids: np.ndarray) -> str:
        return self.base.decode_bytes(ids.tolist()).decode()

    def segments(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The reserved marks in order (as numbers of ``marks``), each with the ids up to the next."""
        at = np.flatnonzero(ids >= self.first)
        ends = np.append(at[1:], len(ids))
        return [(int(ids[a]) - self.first, ids[a + 1 : b]) for a, b in zip(at, ends, strict=True)]


@lru_cache
def codec(vocabulary: str, template: Template) -> Codec:
    return Codec(vocabulary, template)


_ENCODED = "conv_id long, turn long, role string, ids array<int>, opened int, closed int, learned boolean"
_FORMATTED = "conv_id long, turn long, role string, token_start long, input_ids array<int>, loss_mask array<tinyint>"


def encode_turns(turns: DataFrame, template: Template, vocabulary: str) -> DataFrame:
    """Each turn on its own: its ids, and where its content opens and closes."""

    def work(batches: Batches) -> Batches:
        own = codec(vocabulary, template)
        turn, text, close = range(own.first + 1, own.first + 4)
        for batch in small_batches(batches):
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids, opened, closed = [], [], []
            for role, content in zip(roles, texts, strict=True):
                head = [turn, *own.encode(template.escaped(role)), text]
                body = own.encode(template.escaped(content))
                ids.append([*head, *body, close])
                opened.append(len(head))
                closed.append(len(head) + len(body))
            learned = pa.array([r in template.learned for r in roles], pa.bool_())
            arrays = [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32())), pa.array(opened, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(closed, pa.int32()), learned],
                ["conv_id", "turn", "role", "ids", "opened", "closed", "learned"],
            )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of())
    return rows.mapInArrow(work, _ENCODED)


def format_conversations(turns: DataFrame, template: Template = Template(), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(conv_id, turn, role, token_start, input_ids, loss_mask)``: formatted conversations, a row for each turn.

    The rows of a conversation lie in one partition, in order; joined, their ids
    are the conversation, which starts with the ``begin`` mark. ``token_start``
    counts the ids before the row. ``loss_mask`` is 1 on the contents of learned
    roles, marks excluded. Nulls: a null role or text is empty, a null turn comes
    first, null ids form one conversation. Equal turns are ordered by role, then
    by ids; repeated rows stay. Only one row's ids and one sum are held, so a
    conversation may have any number of turns. Long texts are encoded as wholes;
    other columns are not read, and an empty table gives no rows.
    """

    def work(batches: Batches) -> Batches:
        begin = codec(vocabulary, template).first
        current, position = (), 0
        for batch in small_batches(batches):
            if not batch.num_rows:
                continue
            convs = batch.column(0).to_pylist()
            before = [current, *((c,) for c in convs[:-1])]
            fresh = np.array([(c,) != p for c, p in zip(convs, before, strict=True)])
            ids, at = flat_lists(batch.column("ids"))
            ids = np.insert(ids, at[:-1][fresh], begin)
            shift = np.cumsum(fresh)
            starts = at + np.concatenate([[0], shift])
            step = np.zeros(len(ids) + 1, np.int8)
            learned = batch.column("learned").to_numpy(zero_copy_only=False)
            content = (starts[:-1] + fresh)[learned]
            np.add.at(step, content + batch.column("opened").to_numpy()[learned], 1)
            np.add.at(step, content + batch.column("closed").to_numpy()[learned], -1)
            # Ids before the row: those of the conversation in this batch, or since it began in an earlier one.
            first = np.maximum.accumulate(np.where(fresh, starts[:-1], -position))
            token_start = starts[:-1] - first
            current, position = (convs[-1],), int(starts[-1] - first[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(token_start), as_lists(ids, starts), as_lists(np.cumsum(step[:-1], dtype=np.int8), starts)],
                ["conv_id", "turn", "role", "token_start", "input_ids", "loss_mask"],
            )

    dealt = encode_turns(turns, template, vocabulary).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "ids").mapInArrow(work, _FORMATTED)


def rendered(formatted: DataFrame, template: Template = Template(), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(conv_id, turn, string)``: the escaped text form of each row, marks included."""

    def work(batches: Batches) -> Batches:
        own = codec(vocabulary, template)
        for batch in small_batches(batches):
            flat, starts = flat_lists(batch.column(2))
            parts = (own.segments(flat[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True))
            strings = ["".join(template.marks[m] + own.decode(ids) for m, ids in p) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(strings, pa.string())], ["conv_id", "turn", "string"])

    return formatted.select("conv_id", "turn", "input_ids").mapInArrow(work, "conv_id long, turn long, string string")


def read_back(formatted: DataFrame, template: Template = Template(), vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, from nothing but the ids and masks of ``format_conversations``.

    Conversations stream by; of one in progress only hash states are held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Batches) -> Batches:
        own = codec(vocabulary, template)
        marks = [len(m) for m in template.marks]
        current, done = None, []

        def flush() -> pa.RecordBatch:
            rows = [(d[0], d[1], d[2].hexdigest(), d[3], d[4].hexdigest(), d[5]) for d in done]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in small_batches(batches):
            flat, starts = flat_lists(batch.column(1))
            masks = flat_lists(batch.column(2))[0].astype(bool)
            for i, conv in enumerate(batch.column(0).to_pylist()):
                ids, mask = flat[starts[i] : starts[i + 1]], masks[starts[i] : starts[i + 1]]
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append(current)
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for mark, inner in own.segments(ids):
                    text = own.decode(inner)
                    current[5] += marks[mark] + len(text)
                    if mark == 1:
                        current[2].update(template.unescaped(text).encode() + b"\n")
                    elif mark == 2:
                        current[1] += 1
                        current[2].update(template.unescaped(text).encode() + b"\n")
                learned = template.unescaped(own.decode(ids[mask]))
                current[3] += len(learned)
                current[4].update(learned.encode())
            if done:
                yield flush()
                done = []
        if current is not None:
            done.append(current)
        yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(work, schema)
