"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997).

A source whose target is ``r`` times its size gives every document ``floor(r)``
whole copies. The rest is a fixed-size sample with unequal probabilities: the
inclusion probability of a document grows with the root of its words, so that
long documents, which hold more than their words tell, are likelier than short
ones. Documents certain by that are taken, and the probabilities of the others
rescaled to the words then missing. These are ranked by random odds divided by
inclusion odds, and taken in that order until the words are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import fresh, text_of
from assetloom.operators.ranking import ranked
from assetloom.session import cut_lineage

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)  # sources in order take these in turn
LEVEL = 4096  # rank slices per level of the search for the last document taken
DIGITS = 13  # hexadecimal digits of a hash that make the random number


def word_count() -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; a null text has none."""
    marked = F.translate(text_of(), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(marked, " ", -1), "")).cast("long")


def random_odds(key: Column) -> Column:
    """u / (1 - u) with u from the key's MD5, the same in every run; rows of one id and other texts differ."""
    u = (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / 16.0**DIGITS
    return u / (1 - u)


def measured(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """``(doc_id, body, source, size, weight, odds)`` of every row; the text is read once and goes no further.

    Inclusion probabilities are in proportion to ``weight``: the root of the
    number of words, or a column named so, whose null or negative values count
    as 0.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_of()).alias("body"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        random_odds(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(" "), F.md5(text_of()))).alias("odds"),
        *([] if weight is None else [F.col(weight).cast("double").alias("weight")]),
    )
    w = F.sqrt("size") if weight is None else F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("weight", w)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Weights go round the sources in code point order, null last. Targets share
    the total of all sizes by weight, stop at ``most`` times the source, and what
    is cut off is shared again until none is above. Only sums reach the driver.
    """
    keyed = sizes.withColumns({"g": F.lit(0), "none": F.col("source").isNull()})
    ordered = ranked(keyed, ["g"], ["none", "source"], "mix-order")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights)).cast("int"))
    now = ordered.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    now = cut_lineage(now, "mix-sources")
    share, capped = 0.0, -1
    while True:
        # Shares only grow from round to round, so a source that has met its cap stays there.
        full = F.col("w") * share >= F.col("cap")
        row = now.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if row.n == capped or not row.open or not row.total:
            break
        share, capped = max(0.0, (row.total - row.fixed) / row.open), row.n
    target = F.least("cap", F.col("w") * share)
    return now.select("source", "source_size", target.alias("target"))


def _rank_key() -> Column:
    """Random odds over inclusion odds, brought to 0..1 in the same order; never drawn is 1."""
    q = F.col("odds") / (F.col("p") / (1 - F.col("p")))
    return F.when(F.col("p") <= 0, 1.0).otherwise(q / (1 + q))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def inclusion_rates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan (s, missing, ...)`` with ``rate``, the probability per weight, and ``certain``, the words of what it makes certain.

    Rates are raised until ``min(1, rate * weight)`` gives the missing words in
    expectation. They only grow, so what is certain stays so and the rounds end;
    sums per source are all that a round moves.
    """
    plan, certain = plan.withColumn("rate", F.lit(0.0)), -1
    while True:
        met = rows.join(plan.select("s", "rate"), _same_source("source", "s"))
        full = F.col("rate") * F.col("weight") >= 1
        sums = met.groupBy("s").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("certain"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("heavy"),
            F.count_if(full).alias("n"),
        )
        sums = cut_lineage(sums, "mix-certain")
        now = sums.agg(F.sum("n")).first()[0] or 0
        both = plan.drop("certain").join(sums.select(F.col("s").alias("own"), "certain", "heavy"), _same_source("s", "own")).drop("own")
        if now == certain:
            return cut_lineage(both.drop("heavy"), "mix-plan")
        certain = now
        # The missing words never fall below what is certain, rounding aside.
        left = F.greatest(F.col("missing") - F.col("certain"), F.lit(0))
        rate = F.when(F.col("heavy") > 0, F.greatest("rate", left / F.col("heavy"))).otherwise(F.col("rate"))
        plan = cut_lineage(both.withColumn("rate", rate).drop("heavy", "certain"), "mix-rates")


def mix(docs: DataFrame, weight: str | None = None, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(doc_id, body, source, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words the mix takes: whole copies, and for documents in
    the sample one copy more. The document at which a source's sample reaches
    its target gives only the words missing, so that the sample's size is fixed
    in words, as its target is; ties are broken by id, then size. No document
    gives more than ``most`` copies. An empty table gives no rows; documents
    without words give none; a null source is a source. Rows without an id, or
    of one id, draw numbers of their own by their texts; texts are counted whole
    however long, and other columns than those named are not read.
    """
    rows = cut_lineage(measured(docs, weight), "mix-docs")
    per_source = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    plan = source_targets(per_source, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(most)).cast("long"))
    missing = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("missing", F.greatest(missing, F.lit(0).cast("long"))).withColumnRenamed("source", "s")
    plan = inclusion_rates(rows, cut_lineage(plan, "mix-targets"))
    met = rows.join(plan, _same_source("source", "s")).withColumn("p", F.col("rate") * F.col("weight"))
    sure_ones = met.where("p >= 1").withColumn("extra", F.least("size", "missing"))
    met = met.where("p < 1").withColumn("missing", F.greatest(F.col("missing") - F.col("certain"), F.lit(0).cast("long")))
    slices = met.withColumn("rank", _rank_key()).withColumns(
        {"c1": F.floor(F.col("rank") * LEVEL), "c2": F.floor(F.col("rank") * LEVEL * LEVEL) % LEVEL}
    ).select("doc_id", "body", "s", "size", "source_size", "target", "whole", "missing", "rank", "c1", "c2")

    # The slice in which a source reaches its missing words is found from sums,
    # in two levels; only documents of that slice are put in order.
    def reached(df: DataFrame, keys: list[str], level: str, prior: Column) -> DataFrame:
        sums = df.groupBy(*keys, level).agg(F.sum("size").alias("words"), F.first("missing").alias("missing"), F.first(prior).alias("prior"))
        run = Window.partitionBy(*keys).orderBy(level)
        sums = sums.withColumn("upto", F.col("prior") + F.sum("words").over(run))
        hit = sums.where("upto >= missing and upto - words < missing")
        return hit.groupBy(*keys).agg(F.min_by(level, level).alias("cut"), F.min_by(F.col("upto") - F.col("words"), level).alias("before"))

    cut1 = cut_lineage(reached(slices, ["s"], "c1", F.lit(0).cast("long")), "mix-cut1")
    cut1 = cut1.select(F.col("s").alias("s1"), F.col("cut").alias("cut1"), F.col("before").alias("before1"))
    inner = slices.join(cut1, F.col("s").eqNullSafe(F.col("s1")) & (F.col("c1") == F.col("cut1")))
    cut2 = cut_lineage(reached(inner, ["s"], "c2", F.col("before1")), "mix-cut2")
    cut2 = cut2.select(F.col("s").alias("s2"), F.col("cut").alias("cut2"), F.col("before").alias("before2"))
    wide = slices.join(cut1, F.col("s").eqNullSafe(F.col("s1")), "left").join(cut2, F.col("s").eqNullSafe(F.col("s2")), "left")
    edge = (F.col("c1") == F.col("cut1")) & (F.col("c2") == F.col("cut2"))
    below = F.col("missing") > 0
    inside = (F.col("c1") < F.col("cut1")) | ((F.col("c1") == F.col("cut1")) & (F.col("c2") < F.col("cut2")))
    sure = wide.where(~F.coalesce(edge, F.lit(False))).withColumn(
        "extra", F.when(below & (inside | F.col("cut1").isNull()), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy("s").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("missing") - F.col("before2") - (F.sum("size").over(order) - F.col("size"))
    last = wide.where(edge).withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("size", left)))
    columns = ["doc_id", "body", "s", "size", "source_size", "target", "whole", "extra"]
    every = sure.select(columns).union(last.select(columns)).union(sure_ones.select(columns))
    taken = F.least(F.col("whole") * F.col("size") + F.col("extra"), most * F.col("size"))
    return every.select("doc_id", "body", F.col("s").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, by a counted pattern of the row's own."""
    blank = "\\x20\\x09-\\x0D"
    return F.regexp_substr(text, F.concat(F.lit(f"\\A(?:[{blank}]*+[^{blank}]++){{"), n.cast("string"), F.lit("}+")))


def mixed_documents(docs: DataFrame, weight: str | None = None, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy, and ``copy`` (from 1; under another name if taken).

    The last copy of the document at which a source reaches its target ends
    with the last word taken; ``n_chars`` follows if there is one. Rows alike in
    id, text and source give their copies from one of them.
    """
    names = [fresh(docs, x) for x in ("mix_id", "mix_body", "mix_source", "mix_size", "mix_words", "mix_rows")]
    doc, body, source, size, words, rows = names
    taken = mix(docs, weight, weights, most).groupBy("doc_id", "body", "source").agg(
        F.first("size").alias(size), F.sum("taken").alias(words), F.count(F.lit(1)).alias(rows)
    )
    taken = cut_lineage(taken.where(F.col(words) > 0).toDF(*names), "mix-taken")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(body))
    met = docs.join(taken, same & F.col("source").cast("string").eqNullSafe(F.col(source)))
    met = met.where(F.col(rows) == 1).unionByName(met.where(F.col(rows) > 1).dropDuplicates([doc, body, source]))
    copy = fresh(docs, "copy")
    met = met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(words) / F.col(size)))))
    own = F.least(F.col(size), F.col(words) - (F.col(copy) - 1) * F.col(size))
    met = met.withColumn("text", F.when(own == F.col(size), text_of()).otherwise(first_words(text_of(), own)))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.char_length("text").cast("long"))
    return met.select(*docs.columns, copy)
