"""Plain versions of the operators, for tables small enough to hold."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, pairs) -> dict:
    """Least member of each node's component."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo, out[n] = [n], n
        while todo:
            for m in near[todo.pop()]:
                if m not in out:
                    out[m] = n
                    todo.append(m)
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs: list[tuple[int, str | None]]) -> dict:
    prints = {i: fingerprint(t) for i, t in docs}
    ids = list(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return components(ids, pairs)


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or doc == max(holders[key(x)])]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = {s: w for s, w in weight.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()} if open_ else {}
        over = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def taken(docs: list[tuple[int, str | None, str | None]]) -> dict[int, tuple]:
    """doc -> (size, source size, target, taken)."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    text = {d: t or "" for d, t, _ in docs}
    sizes = Counter()
    for d, _, s in docs:
        sizes[s] += size[d]
    goal, out = targets(dict(sizes)), {}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for source, n in sizes.items():
        own = [d for d, _, s in docs if s == source]
        whole = int(goal[source] // n) if n else 0
        missing = max(0, round(goal[source]) - whole * n)
        certain: set = set()
        while True:
            heavy = sum(size[d] ** 1.5 for d in own if d not in certain)
            rate = (missing - sum(size[d] for d in certain)) / heavy if heavy else 0.0
            more = {d for d in own if d in certain or rate * size[d] ** 0.5 >= 1}
            if more == certain:
                break
            certain = more

        def rank(d, certain=certain, rate=rate):
            u, p = (int(md5(f"{d} {md5(text[d])}")[:13], 16) + 0.5) / 16**13, rate * size[d] ** 0.5
            return 0.0 if d in certain else (u / (1 - u)) / (p / (1 - p)) if p > 0 else math.inf

        for d in sorted(own, key=lambda d: (rank(d), d)):
            extra = min(size[d], missing)
            missing -= extra
            out[d] = (size[d], n, goal[source], whole * size[d] + extra)
    return out


def holds_item(text: str | None, items: list[str]) -> bool:
    words = re.findall(r"\w+", (text or "").lower())
    for item in items:
        own = re.findall(r"\w+", item.lower())
        for at in range(len(words) - len(own) + 1):
            if sum(a == b for a, b in zip(own, words[at:], strict=False)) >= 0.8 * len(own):
                return True
    return False


def least_changes(seeds: list[str], size: int) -> list[int]:
    """For 0 to ``size`` words, how many must be changed so that no seed is left whole at any place."""
    span = max(map(len, seeds))
    best, out = {0: 0}, [0]  # the last words, 1 for a changed one: the least changes that lead there
    for n in range(1, size + 1):
        after: dict[int, int] = {}
        for past, changes in best.items():
            for changed in (0, 1):
                now = past << 1 | changed
                if all(n < len(seed) or now & int(seed, 2) for seed in seeds):
                    key = now & ((1 << (span - 1)) - 1)
                    after[key] = min(after.get(key, size), changes + changed)
        best = after
        out.append(min(best.values()))
    return out


def filled_in_middle(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def n_grams(text: str | None) -> list[str]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return [" ".join(words[i : i + run]) for run in (1, 2, 3) for i in range(len(words) - run + 1)]


def resampled(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    """(id, features, weight, score, rank) in the order of ``docs``."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, n_grams(text)))
    for text in target:
        t.update(map(bucket, n_grams(text)))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for doc_id, text in docs:
        features = n_grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r in out if r[1] >= 3 * 20 - 3]
    order = sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(order[: 5 * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r) for r in out]


def exact_groups(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(id, id that stays, group size, whether this row stays), copies of one id told apart by their order."""
    bare = lambda t: (t or "").translate({ord(c): None for c in BLANKS})
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(docs):
        groups[bare(text)].append((-len(text or ""), doc_id is None, doc_id or 0, at))
    best = {k: min(v) for k, v in groups.items()}
    out = []
    for at, (doc_id, text) in enumerate(docs):
        _, none, keep, first = best[bare(text)]
        out.append((doc_id, None if none else keep, len(groups[bare(text)]), at == first))
    return out
