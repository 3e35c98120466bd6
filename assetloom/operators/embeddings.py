"""Embedding text, staleness, refresh and upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom import schemas
from assetloom.functions import dates, json, vectors
from assetloom.functions.text import list_literal
from assetloom.operators.lookup import matching
from assetloom.operators.ranking import latest, latest_stored
from assetloom.session import cut_lineage

# Fixed value: characters of code in a text to embed that is to equal those of older catalogues.
COMPATIBLE_CODE_CHARS = 500

# A provider turns a list of texts into one vector (or None) per text.
Provider = Callable[[list[str]], list[list[float] | None]]
# Texts handed to a provider at once, by number and size, as they and their vectors are Python objects by then.
PROVIDER_TEXTS, PROVIDER_BYTES = 500, 2 * 1024 * 1024


def embedding_text(functions: DataFrame, with_deps: bool = True, code_chars: int | None = None) -> DataFrame:
    """The text to embed of each asset, with its whole code or the first ``code_chars`` characters."""
    code = F.coalesce("code", F.lit(""))
    code = code if code_chars is None else F.substring(code, 1, code_chars)
    tags = list_literal(json.string_list(F.col("tags")))
    deps = list_literal(json.metadata_list(F.col("metadata"), "dependencies"))
    parts = [F.lit("Name: "), F.col("name"), F.lit("\nDesc: "), F.coalesce("description", F.lit("None"))]
    parts += [F.lit("\nTags: "), tags]
    if with_deps:
        parts += [F.lit("\nDeps: "), deps]
    parts += [F.lit("\nCode:\n"), code]
    return functions.select("name", F.concat(*parts).alias("text"))


def stale_embeddings(functions: DataFrame, embeddings: DataFrame, model: str, dimension: int) -> DataFrame:
    """Names whose embedding is missing, of another model or of another length.

    Embeddings are folded per asset first, so repeated rows of one asset never
    reach the join, and neither vectors nor code are read.
    """
    other = F.coalesce(F.col("model_name") != model, F.lit(False)) | F.coalesce(F.col("dimension") != dimension, F.lit(False))
    held = embeddings.groupBy(F.col("function_name").alias("name")).agg(F.bool_or(other).alias("outdated"))
    reason = F.when(F.col("outdated").isNull(), "missing").when(F.col("outdated"), "outdated")
    joined = functions.select("name").join(held, "name", "left")
    return joined.select("name", reason.alias("reason")).filter("reason IS NOT NULL")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The rows in order, in runs of bounded number and size; a text larger than that comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        fitting = np.searchsorted(ends, (ends[start - 1] if start else 0) + PROVIDER_BYTES, side="right")
        end = max(start + 1, min(start + PROVIDER_TEXTS, int(fitting)))
        yield texts.slice(start, end - start)
        start = end


def _embedded(text: Column, provider: Provider) -> Column:
    kind = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])
    none = "provider gave no vector"

    def made(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        try:
            found = provider(rows)
        except Exception as e:
            return pa.array([{"vector": None, "error": str(e)}] * len(rows), type=kind)
        if len(found) != len(rows):
            raise ValueError(f"provider gave {len(found)} vectors for {len(rows)} texts")
        return pa.array([{"vector": v, "error": None if v is not None else none} for v in found], type=kind)

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], type=kind), *map(made, _pieces(texts))])

    return F.arrow_udf(run, "struct<vector:array<float>,error:string>").asNondeterministic()(text)


def embed(texts: DataFrame, provider: Provider) -> DataFrame:
    """Vectors for ``texts(name, text)``; a failure is a NULL vector and its error text.

    The provider runs on the executors and gets up to 500 texts and 2 MiB at a
    time, whatever the size of an Arrow batch; what it raises counts for these.
    """
    made = texts.withColumn("_made", _embedded(F.col("text"), provider))
    return made.select("name", F.col("_made.vector").alias("vector"), F.col("_made.error").alias("error"))


def of_dimension(made: DataFrame, dimension: int) -> DataFrame:
    """Vectors of another length turned into failures: stored, they would be stale at once."""
    wrong = F.col("vector").isNotNull() & (F.size("vector") != dimension)
    text = F.concat(F.lit(f"{dimension} values wanted, got "), F.size("vector"))
    return made.select(
        "name", F.when(~wrong, F.col("vector")).alias("vector"), F.when(wrong, text).otherwise(F.col("error")).alias("error")
    )


def failures(made: DataFrame) -> DataFrame:
    return made.filter("vector IS NULL").select("name", "error")


def as_embedding_rows(made: DataFrame, model: str, as_of: str) -> DataFrame:
    return made.filter("vector IS NOT NULL").select(
        F.xxhash64("name").alias("id"),
        F.col("name").alias("function_name"),
        "vector",
        F.lit(model).alias("model_name"),
        F.size("vector").alias("dimension"),
        F.lit(as_of.replace(" ", "T")).alias("encoded_at"),
    )


def _newest(embeddings: DataFrame) -> list[Column]:
    batch = [F.col("batch")] if "batch" in embeddings.columns else []
    return [dates.parse_any(F.col("encoded_at")), *batch, F.col("id")]


def latest_embeddings(embeddings: DataFrame, layout: str | None = None) -> DataFrame:
    """One row per asset: the last encoded, of equals the last ``batch`` (where streams write one), then the highest id.

    Winners are found without the vectors, by their places in the files of a
    ``written`` table; anything else is written first. In a table ``bucketed``
    by asset all rows of one lie in one bucket, and fold where they are read.
    """
    if layout == "bucketed":
        return latest(embeddings, "function_name", _newest(embeddings))
    stored = embeddings if layout == "written" else cut_lineage(embeddings, "embeddings")
    return latest_stored(stored, "true", "function_name", _newest(embeddings))


def upsert_embeddings(embeddings: DataFrame, new: DataFrame, one_per_asset: bool = True, layout: str | None = None) -> DataFrame:
    """Insert or replace by asset name.

    ``one_per_asset`` says the stored table already holds one row per asset, as
    every table written here does. Stored vectors then pass through an
    anti-join on the (usually small) new names and need no shuffle of their own.
    Tables of other origin are reduced first when it is false; ``layout`` is as
    for ``latest_embeddings``. New rows are written once, as making them may be
    costly.
    """
    columns = schemas.EMBEDDINGS.names
    fresh = latest_embeddings(new.select(*columns))
    held = embeddings if one_per_asset else latest_embeddings(embeddings, layout)
    kept = held.select(*columns).join(fresh.select("function_name"), "function_name", "left_anti")
    return kept.select(*columns).unionByName(fresh)


def embedding_drift(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Cosine of each asset's stored and new vector; NULL where either is zero or their lengths differ."""
    held = embeddings.select("function_name", F.col("vector").alias("held"))
    met = held.join(new.select("function_name", "vector"), "function_name")
    same = F.size("held") == F.size("vector")
    return met.select("function_name", F.when(same, vectors.cosine(F.col("held"), F.col("vector"))).alias("score"))


# Vectors by model and SHA-256 of the text they were made from.
VECTOR_STORE = "model_name string, digest string, vector array<float>"


class EmbedResult(NamedTuple):
    made: DataFrame  # name, vector, error
    store: DataFrame


def embed_reusing(texts: DataFrame, store: DataFrame, provider: Provider, model: str, dimension: int) -> EmbedResult:
    """``embed`` for ``texts(name, text)`` that asks the provider for texts new to it alone, and once for equal ones.

    ``store`` holds the vectors this ``model`` and others have made; the one
    given back has the new ones too. Failures are not kept, so they are tried
    again next time. Texts meet the store as digests; a text that a large share
    of all assets have is folded before it moves, and its digest's rows are left
    to the adaptive splits of the last join.
    """
    whole = texts.select("name", F.coalesce("text", F.lit("")).alias("text"))
    keyed = cut_lineage(whole.select("name", F.sha2("text", 256).alias("digest"), "text"), "texts")
    distinct = keyed.groupBy("digest").agg(F.any_value("text").alias("text"))
    held = store.filter(F.col("model_name") == model).select("digest", "vector")
    known = matching(held, keyed.select("digest").distinct(), "digest", "digest")
    new = distinct.join(held.select("digest"), "digest", "left_anti").select(F.col("digest").alias("name"), "text")
    fresh = cut_lineage(of_dimension(embed(new, provider), dimension), "embedded").withColumnRenamed("name", "digest")
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
    made = keyed.select("name", "digest").join(every, "digest").select("name", "vector", "error")
    kept = fresh.filter("vector IS NOT NULL").select(F.lit(model).alias("model_name"), "digest", "vector")
    return EmbedResult(made, store.select("model_name", "digest", "vector").unionByName(kept))


class RefreshResult(NamedTuple):
    embeddings: DataFrame
    failed: DataFrame
    store: DataFrame | None = None


def refresh_embeddings(
    functions: DataFrame, embeddings: DataFrame, provider: Provider, model: str, dimension: int, as_of: str,
    one_per_asset: bool = True, code_chars: int | None = None, store: DataFrame | None = None,
) -> RefreshResult:
    """Re-embed what is stale: the whole new embeddings table, and ``(name, error)`` for each asset that failed.

    A failed asset keeps the row it has, and stays stale. With a ``store`` of
    vectors by text, texts embedded before are not embedded again, and the
    store is given back with the new ones.
    """
    stale = cut_lineage(stale_embeddings(functions, embeddings, model, dimension), "stale")
    texts = embedding_text(matching(functions, stale), code_chars=code_chars)
    # Written once: the new rows are read three times, and embedding is the costly part.
    if store is None:
        made = cut_lineage(of_dimension(embed(texts, provider), dimension), "embedded")
    else:
        made, store = embed_reusing(texts, store, provider, model, dimension)
    return RefreshResult(upsert_embeddings(embeddings, as_embedding_rows(made, model, as_of), one_per_asset), failures(made), store)


def model_version_check(config: DataFrame, model: str) -> DataFrame:
    """The config table with ``embedding_model`` set."""
    row = config.sparkSession.range(1).select(F.lit("embedding_model").alias("key"), F.lit(model).alias("value"))
    return config.filter("key != 'embedding_model'").unionByName(row)
