"""Fixed schemas of the catalogue tables and of their JSON payloads."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


FUNCTIONS = T.StructType(
    _strings("name", "code", "description", "tags", "metadata", "status", "test_cases")
    + [T.StructField("call_count", T.IntegerType())]
    + _strings("last_called_at", "created_at", "updated_at")
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("model_name", T.StringType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("encoded_at", T.StringType()),
    ]
)

CONFIG = T.StructType(_strings("key", "value"))

STRING_LIST = "array<string>"

# Union of every field seen in ``metadata``; open-ended parts stay JSON text.
METADATA = (
    "dependencies array<string>, internal_dependencies array<string>, saved_at string, "
    "quality_score double, sync_source string, errors array<string>, "
    "verification_error string, quality_feedback string, security string"
)

TEST_CASES = "array<struct<input:string,expected:string>>"

# Nested values are kept as JSON text so that a record of any shape loads.
HUB_RECORD = T.StructType(
    _strings("name", "code", "description")
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
    + _strings("test_cases")
    + [T.StructField("dependencies", T.ArrayType(T.StringType())), T.StructField("quality_score", T.DoubleType())]
    + _strings("updated_at")
)

FACT = "struct<pos:int,alias_idx:int,kind:string,value:string,root:string>"
CODE_FACTS = f"struct<error:string,facts:array<{FACT}>>"

# Column defaults of a newly inserted asset.
DEFAULT_STATUS = "active"
DEFAULT_CALL_COUNT = 0
