"""URL rules by a bit-parallel wildcard automaton.

All glob patterns are packed into multiword Shift-And masks (Baeza-Yates and
Gonnet; gaps as in Navarro and Raffinot). One pass over the characters of a URL
moves the states of every pattern at once; a block of URLs moves together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import ASCII_LOWER, ASCII_UPPER, Batches

BOUNDARY, END = 256, 257  # symbols besides bytes: between host and path, and past the end
_CELLS = 1 << 21  # state words and symbols handled at once
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, with paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """``*`` for any run of characters, ``?`` for one byte, over the whole host and the whole path."""

    host: str
    path: str = "*"


# Hosts blocked where no rule fits; an own choice, passed as a parameter.
BLOCKED = tuple(Glob(f"*{word}*") for word in ("casino", "pills", "bets", "adult", "spam", "ads-", "track", "porn", "viagra"))


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Automaton:
    """Patterns over the symbols of ``.host``, a boundary and ``path``, matched as a whole.

    A pattern of ``n`` symbols has ``n + 1`` states. A gap is a state that stays
    set; gaps of the host do not outlive the boundary.
    """

    def __init__(self, patterns: list[tuple[str, str]]) -> None:
        total = sum(len(self._symbols(h)) + len(self._symbols(p)) + 2 for h, p in patterns)
        self.words = max(1, -(-total // 64))
        self.step = np.zeros((END + 1, self.words), np.uint64)
        self.stay = np.zeros((END + 1, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        at = 0
        for host, path in patterns:
            self._set(self.start, at)
            gaps = []
            for part, inside in ((self._symbols(host), range(256)), ([BOUNDARY], ()), (self._symbols(path), range(END))):
                for symbol in part:
                    if symbol is None:
                        gaps.append((at, inside))
                        continue
                    at += 1
                    for s in range(256) if symbol == -1 else [symbol]:
                        self._set(self.step[s], at)
            for state, symbols in gaps:
                for s in symbols:
                    self._set(self.stay[s], state)
            self.final.append(at)
            at += 1
        self.stay[END] = ~np.uint64(0)

    @staticmethod
    def _symbols(glob: str) -> list[int | None]:
        return [None if c == 42 else -1 if c == 63 else c for c in glob.encode()]

    @staticmethod
    def _set(masks: np.ndarray, bit: int) -> None:
        masks[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def _block(self, texts: list[np.ndarray]) -> np.ndarray:
        longest = max(map(len, texts))
        symbols = np.full((longest, len(texts)), END, np.uint16)
        for i, t in enumerate(texts):
            symbols[: len(t), i] = t
        state = np.repeat(self.start[None], len(texts), 0)
        for row in symbols:
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[row]) | (state & self.stay[row])
        word = np.array(self.final, int) // 64
        bit = (np.array(self.final, int) % 64).astype(np.uint64)
        return ((state[:, word] >> bit) & np.uint64(1)).astype(bool)

    def matches(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """A row per (host, path), a column per pattern."""
        out = np.zeros((len(urls), len(self.final)), bool)
        texts = [
            np.concatenate([np.frombuffer(b"." + h.encode(), np.uint8), [BOUNDARY], np.frombuffer(p.encode(), np.uint8)])
            for h, p in urls
        ]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end, width = at + 1, max(self.words, len(texts[order[at]]))
            while end < len(order) and (end - at + 1) * max(self.words, len(texts[order[end]])) <= _CELLS:
                # Lengths in a block differ by a fourth at most, so padding stays small.
                if len(texts[order[end]]) > 1.25 * width + 16:
                    break
                end += 1
            part = order[at:end]
            out[part] = self._block([texts[i] for i in part])
            at = end
        return out


class Judge:
    def __init__(self, rules: tuple[Rule, ...], blocked: tuple[Glob, ...]) -> None:
        # Longest first; of equally long ones that fit, a block wins.
        self.rules = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
        own = [(f"*.{r.host}", f"{r.path}*") for r in self.rules]
        self.automaton = Automaton(own + [(f".{g.host}", g.path) for g in blocked])

    def __call__(self, urls: list[tuple[str, str]]) -> tuple[list[str | None], list[str]]:
        found = self.automaton.matches(urls)
        n = len(self.rules)
        ruled, blocked = found[:, :n], found[:, n:].any(1)
        first = np.where(ruled.any(1), ruled.argmax(1) if n else 0, -1).tolist()
        names = [self.rules[i].name if i >= 0 else None for i in first]
        verdicts = [self.rules[i].verdict if i >= 0 else "block" if b else "allow" for i, b in zip(first, blocked, strict=True)]
        return names, verdicts


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], blocked: tuple[Glob, ...] = BLOCKED) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row; nothing is shuffled.

    The longest rule that fits decides; without one, a URL is blocked if any
    glob of ``blocked`` matches its host and path, else allowed. Null URLs and
    those without ``://`` have an empty host and path, which no rule fits unless
    it is written so. Rules are a parameter of bounded size and travel with the
    task; repeated rows give repeated results. URLs are judged whole however
    long, other columns are not read, and an empty table gives no rows.
    """

    def work(batches: Batches) -> Batches:
        judge = Judge(rules, blocked)
        for batch in batches:
            urls = [host_and_path(u) for u in batch.column(1).to_pylist()]
            names, verdicts = judge(urls) if urls else ([], [])
            columns = [[u[0] for u in urls], [u[1] for u in urls], names, verdicts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(work, "page_id long, host string, path string, rule string, verdict string")
