"""One parse per asset: syntax state and the facts other operators read."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom import schemas

_FACT_FIELDS = [
    pa.field("pos", pa.int32()),
    pa.field("alias_idx", pa.int32()),
    pa.field("kind", pa.string()),
    pa.field("value", pa.string()),
    pa.field("root", pa.string()),
]


_FACT_NODES = (ast.Import, ast.ImportFrom, ast.Call, ast.Attribute)


def _node_facts(pos: int, node: ast.AST):
    """Facts of one syntax node, in the order its names are written."""
    match node:
        case ast.Import(names=names):
            for i, alias in enumerate(names):
                yield pos, i, "import", alias.name, alias.name.partition(".")[0]
        case ast.ImportFrom(module=str(module)):
            yield pos, 0, "import_from", module, module.partition(".")[0]
        case ast.Call(func=ast.Name(id=called)):
            yield pos, 0, "call", called, called
        case ast.Call(func=ast.Attribute(attr=called)):
            yield pos, 0, "attr_call", called, called
        case ast.Attribute(attr=attr) if attr.startswith("__") and attr.endswith("__"):
            yield pos, 0, "dunder", attr, attr


def parse_one(code: str | None) -> tuple[str | None, list[tuple]]:
    """Error text (or None) and the facts of one source text, breadth first."""
    try:
        tree = ast.parse(code or "")
        nodes = [(pos, node) for pos, node in enumerate(ast.walk(tree)) if isinstance(node, _FACT_NODES)]
        return None, [fact for pos, node in nodes for fact in _node_facts(pos, node)]
    except SyntaxError as e:
        return f"Syntax Error: {e}", []
    except Exception as e:  # e.g. nesting too deep for the parser
        return f"Analysis Error: {e}", []


def _parse_batch(code: pa.Array) -> pa.Array:
    errors, rows, offsets = [], [], [0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in code.to_pylist():
            error, found = parse_one(text)
            errors.append(error)
            rows.extend(found)
            offsets.append(len(rows))
    columns = list(zip(*rows)) or [[]] * len(_FACT_FIELDS)
    structs = pa.StructArray.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, _FACT_FIELDS)], fields=_FACT_FIELDS
    )
    facts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
    return pa.StructArray.from_arrays([pa.array(errors, pa.string()), facts], names=["error", "facts"])


def parsed(code: Column) -> Column:
    """``struct<error, facts>`` of a code column.

    Only the code crosses to Python. Marked non-deterministic so that the
    optimizer never copies it into a pushed-down filter and parses twice.
    """
    return F.arrow_udf(_parse_batch, schemas.CODE_FACTS).asNondeterministic()(code)


def with_facts(assets: DataFrame) -> DataFrame:
    """Add ``error`` and ``facts``; row-local, so nothing is shuffled."""
    return assets.withColumn("_parsed", parsed(F.col("code"))).select(
        *assets.columns, F.col("_parsed.error").alias("error"), F.col("_parsed.facts").alias("facts")
    )


def fact_rows(facts: DataFrame) -> DataFrame:
    """Long form: one row per fact, and one per asset that does not parse."""
    failed = F.array(
        F.struct(
            F.lit(-1).alias("pos"), F.lit(0).alias("alias_idx"), F.lit("syntax_error").alias("kind"),
            F.col("error").alias("value"), F.lit(None).cast("string").alias("root"),
        )
    )
    rows = F.when(F.col("error").isNotNull(), failed).otherwise(F.col("facts"))
    return facts.select("name", F.explode(rows).alias("f")).select("name", "f.*")
