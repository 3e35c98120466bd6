"""Embedding near-dedup: a navigable small-world graph per shard, searched by every vector.

Equal vectors are one class. Classes are dealt to shards of bounded size, each a
graph, and within these to query blocks of bounded size; each pair of a block
and a shard is one task. Beams are widened while full of links, and for a whole
block until an audit against brute force passes. Every link should be found from
both its ends: where the numbers found from one shard in another and back differ,
both searches are run again with wider beams. Cosines are verified in double
precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.components import connected_components
from assetloom.llm.hnsw import Graph
from assetloom.session import cut_lineage


@dataclass(frozen=True)
class Search:
    least: float = 0.9  # cosine of a link
    beam: int = 32  # at first; fourfold at each widening
    widest: int = 1 << 14  # beyond this beam a query is compared with the whole shard
    audited: int = 64  # queries of a block and shard compared with brute force at least, besides as many with links
    audited_share: int = 64  # one in so many queries of a large block
    recall: float = 0.98  # of links, asked for by the audits
    slack: float = 1e-4  # the search in single precision keeps what double precision may accept
    shard_values: int = 12_800_000  # vector components in a shard: 50 MB
    block_values: int = 3_840_000  # each block takes a copy of every graph
    least_shards: int = 4


_PAIRS = 1 << 15  # verified at once
_TASKS = 4096  # to which searches are dealt by hash, eight for each where there are few, so that they seldom meet


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(group: pa.Table) -> pa.Table:
    """The rows of one shard in hash order, each with the links of its node."""
    group = group.sort_by([("place", "ascending"), ("node", "ascending")])
    graph = Graph(_unit(_matrix(group.column("embedding"))).astype(np.float32))
    links = pa.array(graph.flat_links(), pa.list_(pa.int32()))
    position = pa.array(np.arange(group.num_rows, dtype=np.int32))
    return group.select(["dim", "shard", "node", "copies", "embedding"]).append_column("position", position).append_column("links", links)


def _least_of_component(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component over the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


_FOUND = ["dim", "home", "shard", "a", "b", "n"]


def _search(search: Search, beam: int):
    def work(queries: pa.Table, shard: pa.Table) -> pa.Table:
        """Per query the copies linked to it in this shard, links that tie together what is linked here, and how many were found.

        The last is a row without ``a``: links to greater nodes in ``b``, to lesser ones in ``n``.
        """
        if not queries.num_rows or not shard.num_rows:
            return pa.schema([(c, pa.int32() if c == "dim" else pa.int64()) for c in _FOUND]).empty_table()
        place = [queries.column(c)[0] for c in ("dim", "home", "shard")]
        shard = shard.sort_by("position")
        exact, mine = _unit(_matrix(shard.column("embedding"))), _unit(_matrix(queries.column("embedding")))
        unit, q = exact.astype(np.float32), mine.astype(np.float32)
        flat = shard.column("links").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        lengths = flat.value_lengths().to_numpy()
        graph = Graph.from_links(unit, flat.flatten().to_numpy(), np.cumsum(lengths) - lengths)
        low, width = search.least - search.slack, beam
        while True:
            left, right = graph.within(q, low, width, search.widest)
            if width >= min(search.widest, len(unit)) or _audit(q, unit, left, low, search):
                break
            width *= 4
        node, own = shard.column("node").to_numpy(), queries.column("node").to_numpy()
        keep = np.zeros(len(left), bool)
        for at in range(0, len(left), _PAIRS):
            part = slice(at, at + _PAIRS)
            keep[part] = np.einsum("ij,ij->i", mine[left[part]], exact[right[part]]) >= search.least
        keep &= own[left] != node[right]
        left, right = left[keep], right[keep]
        linked = np.bincount(left, shard.column("copies").to_numpy()[right], len(own)).astype(np.int64)
        some = np.flatnonzero(linked)
        names = np.concatenate([own, node])
        least = _least_of_component(len(names), left, len(own) + right)
        tied = np.flatnonzero(least != np.arange(len(names)))
        a, b = np.concatenate([own[some], names[tied]]), names[least[tied]]
        up = int((own[left] < node[right]).sum())
        nulls = lambda n: pa.nulls(n, pa.int64())
        one = lambda n: pa.array([n], pa.int64())
        rows = [
            pa.chunked_array([pa.array(a, pa.int64()), one(None)]),
            pa.chunked_array([nulls(len(some)), pa.array(b, pa.int64()), one(up)]),
            pa.chunked_array([pa.array(linked[some], pa.int64()), nulls(len(b)), one(len(left) - up)]),
        ]
        where = [pa.array([v.as_py()] * (len(a) + 1), v.type) for v in place]
        return pa.Table.from_arrays([*where, *rows], _FOUND).combine_chunks()

    return work


def _audit(q: np.ndarray, unit: np.ndarray, left: np.ndarray, low: float, search: Search) -> bool:
    """Whether evenly spread queries, and ones with links, found their links as brute force does."""
    audited = max(search.audited, len(q) // search.audited_share)
    spread = np.linspace(0, len(q) - 1, min(audited, len(q))).astype(int)
    with_links = np.unique(left)
    picked = with_links[np.linspace(0, len(with_links) - 1, min(audited, len(with_links))).astype(int)]
    some = np.unique(np.concatenate([spread, picked]))
    true = (q[some] @ unit.T >= low).sum()
    return np.bincount(left, minlength=len(q))[some].sum() >= search.recall * true


def _uneven(found: DataFrame, recall: float) -> DataFrame:
    """``(dim, home, shard)`` of searches whose links were not found alike from their other ends."""
    sums = found.where("a is null").groupBy("dim", "home", "shard").agg(F.sum("b").alias("up"), F.sum("n").alias("down"))
    back = sums.select("dim", F.col("home").alias("shard"), F.col("shard").alias("home"), F.col("up").alias("back_up"), F.col("down").alias("back_down"))
    differ = lambda x, y: F.abs(F.col(x) - F.col(y)) > (1 - recall) * F.greatest(x, y)
    return sums.join(back, ["dim", "home", "shard"]).where(differ("up", "back_down") | differ("down", "back_up")).select("dim", "home", "shard")


def linked_vectors(vectors: DataFrame, search: Search = Search()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    ``n_links`` counts the other rows found at the link cosine, equal vectors
    included; ``component_id`` is the least id reachable by links, itself
    included; ``kept`` marks rows that have their component's id. Vectors that
    are null, empty or zero, or hold nulls or non-finite values, link with
    nothing, as do vectors of different length. Rows without an id take part; a
    component without any id has none. Other columns are not read, and a table
    without rows gives none. Links between classes are counted, and
    tied together within a task, so a large group never gives all its pairs.
    """
    wide = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(wide))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = rows.select("vec_id", good.alias("good"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    classes = keyed.where("good").groupBy("h1", "h2").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    classes = classes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")})
    classes = cut_lineage(classes, "embedding-classes")

    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    parts = lambda values: F.ceil(F.col("n") * F.col("dim") / values).cast("int")
    sizes = sizes.select(
        F.col("dim").alias("d"), F.greatest(parts(search.shard_values), F.lit(search.least_shards)).alias("shards"), parts(search.block_values).alias("blocks")
    )
    sizes = cut_lineage(sizes, "embedding-sizes")
    dealt = classes.join(sizes, F.col("dim") == F.col("d")).withColumns(
        {
            "place": F.xxhash64("node"),
            "home": F.pmod(F.xxhash64("node", F.lit(1)), "shards"),
            "block": F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("blocks") / F.col("shards"))),
        }
    )
    graph_schema = f"dim int, shard long, node long, copies long, embedding {wide}, position int, links array<int>"
    graphs = dealt.select("dim", F.col("home").alias("shard"), "node", "copies", "embedding", "place")
    # More ranges than shards, so that no two large shards share one; adaptive execution would put several into a task.
    shards, pairs = sizes.agg(F.sum("shards"), F.sum(F.col("shards") * F.greatest("shards", "blocks"))).first()
    graphs = graphs.repartitionByRange(4 * (shards or 1), "dim", "shard")
    graphs = cut_lineage(graphs.groupBy("dim", "shard").applyInArrow(_build, graph_schema), "embedding-graphs")

    keys = ["dim", "home", "block", "shard"]
    tasks = min(8 * (pairs or 1), _TASKS)
    own_blocks = cut_lineage(dealt.select("dim", "home", "block").distinct(), "embedding-blocks")
    every = own_blocks.select("dim", "home").distinct()
    searches = every.join(every.select("dim", F.col("home").alias("shard")), "dim")

    def run(wanted: DataFrame, beam: int) -> DataFrame:
        """The searches of the blocks of ``home`` in ``shard``: each block goes there, and the shard to each block."""
        queries = dealt.select("dim", "home", "block", "node", "embedding").join(wanted, ["dim", "home"])
        indexes = graphs.join(own_blocks.join(wanted, ["dim", "home"]), ["dim", "shard"])
        met = queries.repartition(tasks, *keys).groupBy(*keys).cogroup(indexes.repartition(tasks, *keys).groupBy(*keys))
        return cut_lineage(met.applyInArrow(_search(search, beam), "dim int, home long, shard long, a long, b long, n long"), "embedding-links")

    found, beam = run(searches, search.beam), search.beam
    while beam < search.widest:
        uneven = cut_lineage(_uneven(found, search.recall), "embedding-uneven")
        if uneven.isEmpty():
            break
        beam = min(16 * beam, search.widest)
        found = found.join(uneven, ["dim", "home", "shard"], "left_anti").unionByName(run(uneven, beam))
    found = found.where("a is not null")

    counts = found.where("b is null").groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("linked"))
    placed = connected_components(found.where("b is not null").select("a", "b"), "embedding-components")
    result = classes.join(counts, F.col("node") == F.col("counted"), "left").select(
        "h1", "h2", F.col("node").alias("own"), "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    result = result.join(placed, F.col("own") == F.col("node"), "left").withColumn("component", F.coalesce("component", "own"))
    result = cut_lineage(result.select("h1", "h2", "component", "least", "n_links"), "embedding-result")
    named = result.groupBy("component").agg(F.min("least").alias("component_id"))
    result = cut_lineage(result.join(named, "component").select("h1", "h2", "n_links", "component_id"), "embedding-named")
    light = keyed.select("vec_id", "good", "h1", "h2")
    out = light.where("good").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = light.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
