"""Single, batched and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators import search
from assetloom.plans.registry import DIMENSION, Tables, query
from assetloom.session import cut_lineage, work_path
from assetloom.sources import cells

_SCORE = "list_cosine_similarity(CAST(e.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))"


def _best(query_source: str, k: int) -> str:
    return f"""
SELECT q.id AS query_id, e.function_name, f.status, f.description, f.tags, f.metadata, f.call_count, {_SCORE} AS raw
FROM {query_source} q, fx_embeddings e JOIN fx_functions f ON f.name = e.function_name
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round({_SCORE}, 9) DESC, e.function_name) <= {k}"""


_FIRST = "(SELECT * FROM fx_embeddings WHERE id = 0)"
_BOOSTED = "CASE WHEN status = 'verified' THEN raw * 1.2 ELSE raw END"
_RANKED = f"""
SELECT *, {_BOOSTED} AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({_BOOSTED}, 9) DESC, function_name) AS INTEGER) AS rank
FROM ({_best('fx_embeddings', 5)})"""


def first_vector(t: Tables) -> list[float]:
    return t.fx_embeddings.filter("id = 0").first()["vector"]


def query_table(t: Tables) -> DataFrame:
    return t.fx_embeddings.select(F.col("id").alias("query_id"), "vector")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("search_topk", f"SELECT function_name, description, tags, metadata, round(raw, 6) AS score FROM ({_best(_FIRST, 10)})")
def search_topk(t):
    hits = search.cosine_topk(t.fx_embeddings, t.fx_functions, first_vector(t))
    return rounded(hits).select("function_name", "description", "tags", "metadata", "score")


@query("search_boosted", f"SELECT function_name, round({_BOOSTED}, 6) AS score, status, description FROM ({_best(_FIRST, 5)})")
def search_boosted(t):
    return rounded(search.boosted_search(t.fx_embeddings, t.fx_functions, first_vector(t)))


@query("search_pruned", f"SELECT function_name, description, tags, metadata, round(raw, 6) AS score FROM ({_best(_FIRST, 10)})")
def search_pruned(t):
    """The same search over vectors stored in cells, most of which it need not read."""
    folder = work_path(t.spark, "cells")
    cells.write_cells(t.fx_embeddings, folder, DIMENSION, cells=64)
    hits = cells.pruned_topk(t.spark, folder, t.fx_functions, first_vector(t)).hits
    return rounded(hits).select("function_name", "description", "tags", "metadata", "score")


def batch(t: Tables) -> DataFrame:
    return search.batch_search(t.fx_embeddings, t.fx_functions, query_table(t), DIMENSION)


@query("search_batch", f"SELECT query_id, function_name, round(score, 6) AS score, status, description, rank FROM ({_RANKED})")
def search_batch(t):
    return rounded(batch(t))


@query("search_batch_blocks", f"SELECT query_id, function_name, round(score, 6) AS score, status, description, rank FROM ({_RANKED})")
def search_batch_blocks(t):
    """The same search by block pairs, as for query tables too large to copy."""
    hits = search.batch_topk(
        t.fx_embeddings, t.fx_functions, query_table(t), DIMENSION, k=5, query_bytes=8 * DIMENSION * 1000
    )
    return rounded(search.boosted_ranks(hits, t.fx_functions))


# A store that publishes only verified assets answers some queries; the rest fall back.
_HYBRID = f"""
WITH r AS ({_RANKED})
SELECT query_id, function_name, score, rank, 'global' AS origin FROM r WHERE status = 'verified'
UNION ALL
SELECT query_id, function_name, score, rank, 'local' AS origin FROM r
WHERE query_id NOT IN (SELECT query_id FROM r WHERE status = 'verified')"""


def hybrid(t: Tables) -> DataFrame:
    local = cut_lineage(batch(t).drop("description"), "hits")  # used as both stores' answers, without texts
    hits = local.select("query_id", "function_name", "score", "rank")
    shared = local.filter("status = 'verified'").select(*hits.columns)
    return search.hybrid_candidates(shared, hits)


@query("search_hybrid", f"SELECT query_id, function_name, round(score, 6) AS score, rank, origin FROM ({_HYBRID})")
def search_hybrid(t):
    return rounded(hybrid(t))


_SELECTED = f"""
WITH h AS ({_HYBRID}), first AS (SELECT query_id, arg_min(function_name, rank) AS first_name FROM h GROUP BY query_id),
s AS (SELECT f.query_id, coalesce(nullif(r.selected_name, ''), f.first_name) AS selected_name
  FROM first f LEFT JOIN fx_rerank r ON r.query_id = f.query_id)
SELECT query_id, selected_name,
  EXISTS (SELECT 1 FROM h WHERE h.query_id = s.query_id AND h.function_name = s.selected_name) AS in_candidates FROM s"""


@query("search_select", _SELECTED)
def search_select(t):
    return search.select_candidate(hybrid(t), t.fx_rerank)


@query("search_attach_code", f"""
WITH p AS ({_SELECTED})
SELECT p.query_id, p.selected_name, CASE WHEN f.name IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN f.status = 'verified' THEN concat('# shared', chr(10), f.code) ELSE f.code END AS code,
  CASE WHEN f.name IS NULL THEN concat('Could not retrieve code for ''', p.selected_name, '''') END AS message
FROM p LEFT JOIN fx_functions f ON f.name = p.selected_name AND f.status != 'deleted'""")
def search_attach_code(t):
    """The shared store's text of a published asset differs from the own one, so the row tells which was taken."""
    functions = t.fx_functions
    selected = search.select_candidate(hybrid(t), t.fx_rerank)
    shared = functions.filter("status = 'verified'").withColumn("code", F.concat(F.lit("# shared\n"), "code"))
    return search.attach_code(selected, shared, functions.filter("status != 'deleted'"))


_POPULAR = "raw * (1 + 0.1 * ln(1 + call_count))"


@query("search_popularity", f"""
SELECT query_id, function_name, round({_POPULAR}, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({_POPULAR}, 9) DESC, function_name) AS INTEGER) AS rank
FROM ({_best('fx_embeddings', 10)}) QUALIFY rank <= 5""")
def search_popularity(t):
    hits = search.batch_topk(t.fx_embeddings, t.fx_functions, query_table(t), DIMENSION)
    return rounded(search.popularity_rank(hits, t.fx_functions, k=5))


@query("search_unscorable", """
SELECT count(*) FILTER (WHERE vector IS NULL) AS no_vector, count(*) FILTER (WHERE len(vector) != 64) AS wrong_length,
  count(*) FILTER (WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) = 0) AS zero_vector
FROM fx_embeddings""")
def search_unscorable(t):
    return search.unscorable(t.fx_embeddings, DIMENSION)
