"""Secret scan and syntax-tree verdicts over a code corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Secret patterns, tried in this order.
SECRET_PATTERNS = [
    r"AIza[0-9A-Za-z_-]{35}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"sk-[a-zA-Z0-9]{48}",
]

# Names a catalogued function must not use.
FORBIDDEN_IMPORTS = [
    "os", "sys", "subprocess", "shutil", "pickle", "marshal", "shelve", "socket", "requests", "urllib", "http",
    "webbrowser", "ftplib", "telnetlib", "smtplib", "platform", "ctypes", "builtins", "importlib",
    "multiprocessing", "threading", "pysqlite3", "sqlite3",
]
FORBIDDEN_CALLS = [
    "eval", "exec", "compile", "breakpoint", "__import__", "system", "popen", "spawn", "fork", "kill",
]
FORBIDDEN_BUILTINS = [
    "open", "getattr", "setattr", "delattr", "hasattr", "globals", "locals", "vars", "dir", "help", "input",
]
ALLOWED_DUNDERS = ["__name__", "__init__"]

# Message of each violation kind.
MESSAGES = {
    "import": "Security Block: Import of '%s' is forbidden.",
    "import_from": "Security Block: Import from '%s' is forbidden.",
    "call": "Security Block: Direct call to '%s' is forbidden.",
    "attr_call": "Security Block: Attribute call '%s' is forbidden.",
    "dunder": "Security Block: Access to dunder attribute '%s' is forbidden.",
}


@dataclass(frozen=True)
class SecurityRules:
    """Name lists a caller may widen or relax."""

    imports: list[str] = field(default_factory=lambda: FORBIDDEN_IMPORTS)
    calls: list[str] = field(default_factory=lambda: FORBIDDEN_CALLS)
    builtins: list[str] = field(default_factory=lambda: FORBIDDEN_BUILTINS)
    allowed_dunders: list[str] = field(default_factory=lambda: ALLOWED_DUNDERS)

    def broken_by(self, fact: Column) -> Column:
        kind, value, root = fact["kind"], fact["value"], fact["root"]
        return (
            (kind.isin("import", "import_from") & root.isin(self.imports))
            | ((kind == "call") & value.isin(self.calls + self.builtins))
            | ((kind == "attr_call") & value.isin(self.calls))
            | ((kind == "dunder") & ~value.isin(self.allowed_dunders))
        )


def first_secret(text: Column, patterns: list[str] = SECRET_PATTERNS) -> Column:
    """First match of the first pattern that matches at all, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def scan_secrets(df: DataFrame, text_col: str, patterns: list[str] = SECRET_PATTERNS) -> DataFrame:
    match = first_secret(F.col(text_col), patterns)
    return df.withColumn("secret", F.coalesce(match, F.lit(""))).withColumn("has_secret", F.col("secret") != "")


def all_secrets(df: DataFrame, key: str, text_col: str, patterns: list[str] = SECRET_PATTERNS) -> DataFrame:
    """Every match of every pattern as a row."""

    def matches(number: int, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(number).alias("pattern_no"), m.alias("secret")))

    rows = F.concat(*[matches(i, p) for i, p in enumerate(patterns)])
    return df.select(key, F.explode(rows).alias("m")).select(key, "m.*")


def _message(fact: Column) -> Column:
    text = F.lit(None).cast("string")
    for kind, template in MESSAGES.items():
        text = F.when(fact["kind"] == kind, F.format_string(template, fact["value"])).otherwise(text)
    return text


def violations(facts: DataFrame, rules: SecurityRules = SecurityRules()) -> DataFrame:
    """Every violation in walk order, not only the first."""
    broken = F.filter(F.col("facts"), rules.broken_by)
    rows = facts.select("name", F.explode(broken).alias("f"))
    return rows.select("name", "f.pos", "f.alias_idx", _message(F.col("f")).alias("message"))


def verdict_message(rules: SecurityRules = SecurityRules()) -> Column:
    """Parse error, else the first violation's message, else ''."""
    first = F.get(F.transform(F.filter(F.col("facts"), rules.broken_by), _message), F.lit(0))
    return F.coalesce(F.col("error"), first, F.lit(""))


def security_verdict(facts: DataFrame, rules: SecurityRules = SecurityRules()) -> DataFrame:
    """Row-local: the rule lists travel as literals, so no join and no shuffle."""
    return facts.select("name", verdict_message(rules).alias("message")).select(
        "name", (F.col("message") == "").alias("is_safe"), "message"
    )


def syntax_status(facts: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return facts.select(
        "name",
        F.when(ok, "pending").otherwise("broken").alias("status"),
        F.when(ok, 50).otherwise(0).alias("quality_score"),
    )
