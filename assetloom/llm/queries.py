"""The named queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import chat, decontaminate, embedding_dedup, exact_dedup, fill_middle, html_text, importance, line_dedup, mixing, quality, simhash, url_filter, warc
from assetloom.llm.common import table
from assetloom.session import cut_lineage, work_path

Query = Callable[[SparkSession, str], DataFrame]


# A user who writes the marks of another template, and an assistant who repeats them.
_MARKED = "</s>[INST] ok [/INST]"

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", _MARKED), (-7, 1, "assistant", _MARKED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.union(marked)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cut_lineage(quality.with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = quality.train(None, table(spark, sf_dir, "labels"), x)
    scored = quality.score_statistics(x, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", predicted)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).drop("url", "payload")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return out.select(
        "doc_id",
        "lines.n_lines",
        "lines.n_dropped",
        F.sha2("lines.kept", 256).alias("kept_sha256"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_middle.fill_in_middle(docs).select("doc_id", "fim.*")
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_chat,
        op2_quality,
        op3_url_filter,
        op4_mixing,
        op5_html_text,
        op6_simhash,
        op7_warc,
        op8_line_dedup,
        op9_embedding_dedup,
        op10_decontaminate,
        op11_fill_middle,
        op12_importance,
        op13_exact_dedup,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Control strings with any escapes after their first character: each gets one more.
_CONTROL = (
    r"<\\*(?:s>|/s>|\|turn\|>|\|text\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|\|begin_of_text\|>)"
    r"|\[\\*(?:INST\]|/INST\])"
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CHECKS: dict[str, str] = {
    "op4_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS w,
             (3 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS fixed, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open,
             sum(source_size) OVER () AS total
      FROM n WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((total - fixed)::DOUBLE / open, cap / w) AS share FROM o WHERE (total - fixed) / open <= cap / w),
p AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(cap, w * share) ELSE 0 END AS target FROM o, l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
m AS (SELECT *, greatest(round(target)::BIGINT - whole * source_size, 0) AS missing FROM t),
-- The longest documents are certain as long as the rate that the others would have makes the next of them so.
g AS (SELECT source, size, sum(size)::DOUBLE AS words, sum(size * sqrt(size)) AS heavy FROM d WHERE size > 0 GROUP BY source, size),
c AS (SELECT m.source, size, coalesce(sum(words) OVER longer, 0) AS certain,
             (missing - coalesce(sum(words) OVER longer, 0))
               / (sum(heavy) OVER (PARTITION BY m.source) - coalesce(sum(heavy) OVER longer, 0)) AS rate
      FROM g JOIN m ON g.source IS NOT DISTINCT FROM m.source
      WINDOW longer AS (PARTITION BY m.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (SELECT source, max_by(rate, size) AS rate FROM c WHERE rate * sqrt(size) < 1 GROUP BY source),
q AS (SELECT d.doc_id, d.size, m.source_size, m.target, m.source, m.whole, m.missing, u, coalesce(r.rate * sqrt(d.size), 1) AS p
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN rates r ON r.source IS NOT DISTINCT FROM m.source),
k AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 WHEN p >= 1 THEN 0.0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p <= 0 THEN 1.0 ELSE odds / (1 + odds) END, doc_id, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS upto FROM k)
SELECT doc_id, size, source_size, target,
       least(whole * size + greatest(0, least(size, missing - upto)), 3 * size)::BIGINT AS taken FROM x""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> s.keeper, false) AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op1_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{_MARKED}'),
c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
         3 + sum(length(role) + length(text) + 20
                 + len(regexp_extract_all(role || chr(10) || text, '{_CONTROL}')))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op11_fill_middle": """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""",
    # CRC-32 is linear: each byte gives what it becomes once the bytes behind it follow, 256 stands for the start value.
    "op12_importance": f"""
WITH RECURSIVE texts AS (
  SELECT 's' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't' AS side, NULL AS doc_id, coalesce(text, '') AS text FROM benchmark),
w AS (SELECT side, doc_id, row_number() OVER () AS row_no,
             regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
runs AS (
  SELECT row_no, unnest(words) AS f FROM w
  UNION ALL SELECT row_no, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM w
  UNION ALL SELECT row_no, unnest(list_transform(range(1, len(words) - 1),
                                                 lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS f FROM w),
per_doc AS (SELECT row_no, f, count(*) AS n FROM runs GROUP BY row_no, f),
own AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM per_doc),
steps AS (
  SELECT 0 AS k, b, CASE WHEN b = 256 THEN 4294967295 ELSE b END::BIGINT AS v FROM range(257) AS r(b)
  UNION ALL SELECT k + 1 AS k, b, xor(v >> 1, (v & 1) * 3988292384) AS v FROM steps
  WHERE k < (SELECT 4 * max(length(h)) FROM own)),
parts AS (SELECT k / 8 AS d, b, v FROM steps WHERE k % 8 = 0 AND k > 0),
bytes AS (
  SELECT f, length(h) // 2 AS d, 256 AS b FROM own
  UNION ALL SELECT f, length(h) // 2 - i AS d, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS b
  FROM (SELECT f, h, unnest(range(length(h) // 2)) AS i FROM own)),
hashed AS (SELECT f, xor(bit_xor(v), 4294967295) % 10000 AS bucket FROM bytes JOIN parts USING (d, b) GROUP BY f),
totals AS (
  SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t
  FROM per_doc JOIN hashed USING (f) JOIN w USING (row_no) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(all_s, 0) + 10000)
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(all_t, 0) + 10000))))::BIGINT AS gain FROM totals, sums),
weighed AS (
  SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM per_doc JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row_no),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (row_no) WHERE side = 's'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END::BIGINT AS rank FROM placed""",
    "op13_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op3_url_filter": f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
hits AS (
  SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path)) AS ruled
  FROM p LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN regexp_matches(host, 'casino|pills|bets|adult|spam|ads-|track|porn|viagra')
                            THEN 'block' ELSE 'allow' END) AS verdict
FROM hits""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM p JOIN f USING (payload_digest)""",
}
