"""Fill-in-the-middle by counted quantifiers, in built-in functions only.

A text is a row of units, a unit being a run of letters or any other code point.
``regexp_count`` gives their number ``n``; two cuts ``a <= b`` are drawn from a
hash of the id, and a pattern of the row's own,
``\\A((?:unit){a}+)((?:unit){b-a}+)(rest)\\z``, captures prefix, middle and suffix
in one match, which the replacement puts into their new order. All quantifiers
are possessive, so the match runs forward once and needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import fresh, text_of

UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 10, 20  # per cent: texts left plain; of the others, suffix first
# Units are counted in blocks, so that no list of all units is ever held.
BLOCK = 1000


def count_units(text: Column) -> Column:
    """The number of units: whole blocks by one counted pattern, then the units of what is left."""
    block = f"(?:{UNIT}){{{BLOCK}}}+"
    blocks = F.regexp_count(text, F.lit(f"\\G{block}"))
    left = F.regexp_replace(text, f"\\A(?:{block})*+", "")
    return blocks.cast("long") * BLOCK + F.regexp_count(left, F.lit(UNIT))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _holds_mark(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def _in_order(text: Column, a: Column, b: Column, form: Column) -> Column:
    unit = f"(?:{UNIT})"
    pattern = F.concat(F.lit(f"\\A({unit}{{"), a, F.lit(f"}}+)({unit}{{"), b - a, F.lit("}+)([\\s\\S]*+)\\z"))
    psm, spm = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    return F.when(form == "plain", text).otherwise(
        F.regexp_replace(text, pattern, F.when(form == "spm", F.lit(spm)).otherwise(F.lit(psm)))
    )


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a transformed text, null if it is plain.

    No mark can begin inside another or across its ends, and texts that hold
    one are left plain, so the first of each is the true one.
    """
    head = F.substring_index(output, MIDDLE, 1)
    first = lambda mark: F.substring_index(F.substr(head, F.lit(1 + len(PREFIX))), mark, 1)
    second = lambda mark: F.substring_index(head, mark, -1)
    psm, spm = form == "psm", form == "spm"
    return (
        F.when(psm, first(SUFFIX)).when(spm, second(PREFIX)),
        F.when(psm | spm, F.substring_index(output, MIDDLE, -1)),
        F.when(psm, second(SUFFIX)).when(spm, first(PREFIX)),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed."""
    return F.when(form == "plain", output).otherwise(F.concat(*pieces(output, form)))


def fill_in_middle(docs: DataFrame, seed: int = 1, into: str = "fim") -> DataFrame:
    """``docs`` and a struct column ``into``: ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``form`` is ``psm``, ``spm`` or ``plain``; a plain output is the text itself
    and its two lengths are null. Empty and null texts, texts that hold a mark
    and a tenth of the others are plain. A row's cuts follow from its id and
    number of units alone: reruns agree, repeated rows come out alike, rows
    without an id share their draws. Texts are whole whatever their length. A
    column that is already named ``into`` is replaced, all others stay whatever
    their names; a table without rows gives none.
    """
    text, n, h, a, b, form, output = (fresh(docs, f"{into}_{x}") for x in ("text", "n", "h", "a", "b", "form", "output"))
    cut = F.array(*[F.get(F.col(h), i) % (F.col(n) + 1) for i in range(2)])
    plain = (F.col(text) == "") | _holds_mark(F.col(text)) | (F.get(F.col(h), 2) % 100 >= 100 - PLAIN_SHARE)
    kind = F.when(plain, F.lit("plain")).when(F.get(F.col(h), 3) % 100 < SPM_SHARE, F.lit("spm")).otherwise(F.lit("psm"))
    drawn = docs.withColumns({text: text_of(), h: F.array(*draws(F.col("doc_id"), seed))})
    drawn = drawn.withColumn(n, count_units(F.col(text)))
    drawn = drawn.withColumns({a: F.array_min(cut), b: F.array_max(cut), form: kind})
    done = drawn.withColumn(output, _in_order(F.col(text), F.col(a), F.col(b), F.col(form)))
    # The marks' places give the lengths: the prefix lies before one mark, the middle behind the last.
    prefix, middle, _ = pieces(F.col(output), F.col(form))
    out = F.struct(
        F.col(n).alias("n"),
        F.col(form).alias("form"),
        F.char_length(prefix).cast("long").alias("prefix_chars"),
        F.char_length(middle).cast("long").alias("middle_chars"),
        F.col(output).alias("output"),
    )
    return done.withColumn(into, out).drop(text, n, h, a, b, form, output)
