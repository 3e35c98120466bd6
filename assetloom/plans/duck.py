"""Fragments of DuckDB SQL shared by the checks."""

from __future__ import annotations

from assetloom.functions.text import EMOJI_PATTERN

SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def clean_text(expr: str) -> str:
    plain = f"regexp_replace(replace(coalesce({expr}, ''), chr(12288), ' '), '{EMOJI_PATTERN}', '', 'g')"
    return strip(f"regexp_replace(regexp_replace({plain}, ' +', ' ', 'g'), '_+', '_', 'g')")


def clean_code(expr: str) -> str:
    return f"replace(regexp_replace(coalesce({expr}, ''), '{EMOJI_PATTERN}', '', 'g'), chr(12288), ' ')"


def strings(expr: str) -> str:
    """JSON list text as VARCHAR[]."""
    return f"CAST(json_extract_string({expr}, '$[*]') AS VARCHAR[])"


def meta_strings(expr: str, field: str) -> str:
    return f"CAST(json_extract_string({expr}, '$.{field}[*]') AS VARCHAR[])"


def rounded_int(expr: str, field: str) -> str:
    return f"CAST(json_extract({expr}, '$.{field}') AS INTEGER)"


def joined(list_expr: str) -> str:
    return f"array_to_string({list_expr}, '|')"


def list_literal(list_expr: str) -> str:
    return f"(CASE WHEN len({list_expr}) > 0 THEN concat('[''', array_to_string({list_expr}, ''', '''), ''']') ELSE '[]' END)"


def doc_id(name: str = "name") -> str:
    return f"CAST(substring({name}, 4) AS BIGINT)"
