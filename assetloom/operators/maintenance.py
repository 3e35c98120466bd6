"""Table maintenance as set-at-a-time rewrites: changes first, then a merge.

Stored rows that a batch does not touch pass an anti-join on the batch's names
and nothing else; only touched rows look up what they keep.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom import schemas
from assetloom.functions import dates
from assetloom.operators.cleaning import default_description, sanitize
from assetloom.operators.facts import with_facts
from assetloom.operators.lookup import matching
from assetloom.operators.ranking import latest_stored
from assetloom.operators.security import SecurityRules, first_secret, verdict_message
from assetloom.session import cut_lineage

COLUMNS = schemas.FUNCTIONS.names

# Fixed value: answer to a save that holds a secret.
SECRET_REJECTION = "REJECTED: Secret detected in code."


class SaveResult(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _metadata_text(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def replace_rows(functions: DataFrame, changed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Stored rows other than the changed ones, plus the changed ones.

    ``names`` may give the changed names where they are cheaper to read.
    """
    gone = (changed if names is None else names).select("name")
    kept = functions.select(*COLUMNS).join(gone, "name", "left_anti")
    return kept.select(*COLUMNS).unionByName(changed.select(*COLUMNS))


def prepare_saves(batch: DataFrame, as_of: str, gate: str = "draft", rules: SecurityRules = SecurityRules()) -> SaveResult:
    """Default, sanitise, parse and gate a batch of save requests.

    ``batch``: seq, name, code, description, tags array, dependencies array,
    test_cases JSON, and optionally skip_test. Of requests with one name the
    last by ``seq`` that passes the gate is stored. The ``draft`` gate rejects
    secrets; ``strict`` also rejects unsafe or unparsable code. The judged batch
    is written once, so each request is cleaned and parsed once.
    """
    skips = F.coalesce("skip_test", F.lit(False)) if "skip_test" in batch.columns else F.lit(False)
    described = batch.withColumn("description", default_description(F.col("description"), as_of))
    clean = with_facts(sanitize(described))
    reason = F.when(first_secret(F.col("code")).isNotNull(), SECRET_REJECTION)
    if gate == "strict":
        reason = reason.when(verdict_message(rules) != "", F.concat(F.lit("REJECTED: "), verdict_message(rules)))
    parses = F.col("error").isNull()
    now = F.lit(as_of.replace(" ", "T"))
    meta = _metadata_text(
        dependencies=F.coalesce("dependencies", F.array().cast("array<string>")),
        saved_at=now,
        quality_score=F.when(parses, 50).otherwise(0),
    )
    judged = clean.select(
        "seq", "name", "code", "description", F.to_json("tags").alias("tags"), meta.alias("metadata"),
        F.when(parses, "pending").otherwise("broken").alias("status"),
        F.coalesce("test_cases", F.lit("[]")).alias("test_cases"), now.alias("created_at"), now.alias("updated_at"),
        skips.alias("skip_test"), reason.alias("reason"),
    )
    judged = cut_lineage(judged, "judged")
    accepted = latest_stored(judged, "reason IS NULL", "name", "seq").drop("reason")
    return SaveResult(accepted, judged.filter("reason IS NOT NULL").select("seq", "name", "reason"))


def saved_rows(functions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Full rows to store; a replaced asset keeps its use counter, not its age."""
    kept = matching(functions.select("name", "call_count", "last_called_at"), accepted)
    joined = accepted.drop("seq", "skip_test").join(kept, "name", "left")
    return joined.withColumn("call_count", F.coalesce("call_count", F.lit(schemas.DEFAULT_CALL_COUNT))).select(*COLUMNS)


def save_assets(functions: DataFrame, batch: DataFrame, as_of: str, gate: str = "draft") -> SaveResult:
    """``accepted`` is the whole new functions table here.

    The accepted requests are used three times, so they are written once. Their
    true size then decides how the stored table is met.
    """
    prepared = prepare_saves(batch, as_of, gate)
    accepted = cut_lineage(prepared.accepted, "accepted")
    return SaveResult(replace_rows(functions, saved_rows(functions, accepted), accepted), prepared.rejected)


def delete_assets(functions: DataFrame, embeddings: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = names.select("name")
    return (
        functions.join(gone, "name", "left_anti"),
        embeddings.join(gone.withColumnRenamed("name", "function_name"), "function_name", "left_anti"),
    )


def apply_usage(functions: DataFrame, delta: DataFrame) -> DataFrame:
    """Add ``delta(name, calls, last_ts)``; unknown names fall away.

    The delta is written first: a roll-up is far smaller than its log, and only
    its true size lets the planner copy it instead of moving the functions.
    """
    delta = cut_lineage(delta, "usage")
    joined = functions.select(*COLUMNS).join(delta.select("name", "calls", "last_ts"), "name", "left")
    stamp = dates.iso_text(F.col("last_ts"))
    used = F.col("calls").isNotNull()
    return joined.withColumns(
        {
            "call_count": (F.col("call_count") + F.coalesce("calls", F.lit(0))).cast("int"),
            "last_called_at": F.when(used, stamp).otherwise(F.col("last_called_at")),
            "updated_at": F.when(used, stamp).otherwise(F.col("updated_at")),
        }
    ).select(*COLUMNS)


def last_records(records: DataFrame, written: bool = False) -> DataFrame:
    """One record per name: the last updated, then the last file path.

    Records are parsed once, into a table, unless they are ``written`` already;
    names and times alone tell the last ones.
    """
    with_path = records if "file_path" in records.columns else records.withColumn("file_path", F.lit(""))
    stored = with_path if written else cut_lineage(with_path, "parsed-records")
    order = [dates.parse_any(F.col("updated_at")), F.coalesce("file_path", F.lit(""))]
    last = latest_stored(stored, "true", "name", order, label="last-places")
    last = last.withColumn("description", F.coalesce("description", F.lit("")))
    return cut_lineage(last.drop("file_path"), "records")


def hub_actions(functions: DataFrame, records: DataFrame) -> DataFrame:
    """The last record per name and what a merge does with it."""
    return record_actions(functions, last_records(records))


def _digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def record_actions(functions: DataFrame, last: DataFrame) -> DataFrame:
    """What a merge does with each of ``last_records``. Only a different code or description counts as a change.

    Texts are compared by their SHA-256, so that stored texts are not moved, nor
    those of the records where only ``name`` and ``action`` are asked for.
    """
    old = functions.select("name", F.lit(True).alias("stored"), _digest("code").alias("old_code"), _digest("description").alias("old_description"))
    stored = matching(old, last)
    known = last.withColumns({"new_code": _digest("code"), "new_description": _digest("description")})
    joined = known.join(stored, "name", "left")
    same = F.col("new_code").eqNullSafe(F.col("old_code")) & F.col("new_description").eqNullSafe(F.col("old_description"))
    action = (
        F.when(F.coalesce("stored", F.lit(False)) & same, "unchanged")
        .when(F.col("new_code").isNull(), "skipped")
        .when(F.col("stored"), "update")
        .otherwise("insert")
    )
    return joined.withColumn("action", action).drop("stored", "old_code", "old_description", "new_code", "new_description")


def _fresh(records: DataFrame, as_of: str) -> DataFrame:
    """What a record sets in a stored row."""
    none = F.array().cast("array<string>")
    now = F.lit(as_of.replace(" ", "T"))
    score = F.coalesce("quality_score", F.lit(0.0))
    # Whole scores are written without a fraction.
    score_text = F.when(score == F.floor(score), score.cast("bigint").cast("string")).otherwise(score.cast("string"))
    deps = F.to_json(F.coalesce("dependencies", none))
    meta = F.concat(
        F.lit('{"dependencies":'), deps, F.lit(',"quality_score":'), score_text, F.lit(',"sync_source":"github-hub"}')  # fixed value
    )
    return records.select(
        "name", "code", "description", F.to_json(F.coalesce("tags", none)).alias("tags"), meta.alias("metadata"),
        now.alias("now"),
    )


def _inserted(fresh: DataFrame) -> DataFrame:
    """Full rows of records whose name is new."""
    none = F.lit(None).cast("string")
    return fresh.select(
        "name", "code", "description", "tags", "metadata", F.lit(schemas.DEFAULT_STATUS).alias("status"),
        none.alias("test_cases"), F.lit(schemas.DEFAULT_CALL_COUNT).alias("call_count"), none.alias("last_called_at"),
        F.col("now").alias("created_at"), F.col("now").alias("updated_at"),
    )


CHANGED = "action IN ('insert', 'update')"


def hub_rows(functions: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """Full rows to store for inserts and updates."""
    return changed_rows(functions, actions.filter(CHANGED), as_of)


def changed_rows(functions: DataFrame, changed: DataFrame, as_of: str) -> DataFrame:
    """Full rows to store for records that are known to be inserts or updates."""
    fresh = _fresh(changed, as_of)
    kept = matching(functions, fresh).select(
        "name", "status", "test_cases", "call_count", "last_called_at", "created_at", F.lit(1).alias("stored")
    )
    joined = fresh.join(kept, "name", "left")
    is_new = F.col("stored").isNull()
    return joined.select(
        "name", "code", "description", "tags", "metadata",
        F.when(is_new, schemas.DEFAULT_STATUS).otherwise(F.col("status")).alias("status"),
        "test_cases",
        F.when(is_new, schemas.DEFAULT_CALL_COUNT).otherwise(F.col("call_count")).alias("call_count"),
        "last_called_at",
        F.when(is_new, F.col("now")).otherwise(F.col("created_at")).alias("created_at"),
        F.col("now").alias("updated_at"),
    )


def merge_hub(functions: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """The functions table after taking in a record folder; applying it twice changes nothing more.

    One pass over the stored rows, which change where their record differs; only
    names are read a second time, to tell which records are new.
    """
    fresh = _fresh(last_records(records).filter("code IS NOT NULL"), as_of)
    new = fresh.select(*[F.col(c).alias(f"new_{c}") for c in fresh.columns])
    same = F.col("code").eqNullSafe(F.col("new_code")) & F.col("description").eqNullSafe(F.col("new_description"))
    changed = F.col("new_name").isNotNull() & ~same
    value = {c: F.col(f"new_{c}") for c in ("code", "description", "tags", "metadata")} | {"updated_at": F.col("new_now")}
    met = functions.select(*COLUMNS).join(new, F.col("name") == F.col("new_name"), "left")
    stored = met.select(*[F.when(changed, value[c]).otherwise(F.col(c)).alias(c) if c in value else c for c in COLUMNS])
    return stored.unionByName(_inserted(fresh.join(functions.select("name"), "name", "left_anti")))


def apply_status(functions: DataFrame, verdicts: DataFrame, as_of: str) -> DataFrame:
    """Set the status named by ``verdicts(name, status)``; of several the first in text order, which is the worse."""
    new = verdicts.groupBy("name").agg(F.min("status").alias("new_status"))
    touched = F.col("new_status").isNotNull()
    return functions.select(*COLUMNS).join(new, "name", "left").withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "updated_at": F.when(touched, F.lit(as_of.replace(" ", "T"))).otherwise(F.col("updated_at")),
        }
    ).select(*COLUMNS)


def archive_assets(functions: DataFrame, candidates: DataFrame, as_of: str) -> DataFrame:
    """Set candidates to ``archived``; their names are written first, for their true size."""
    names = cut_lineage(candidates.select("name", F.lit("archived").alias("status")), "archived")
    return apply_status(functions, names, as_of)
