"""Each operator against a plain version, with the odd rows every table may hold."""

from __future__ import annotations

import dataclasses
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetloom.llm import chat, decontaminate, embedding_dedup, hnsw, html_text, line_dedup, mixing, quality, simhash, url_filter, warc
from assetloom.llm.components import connected_components
from assetloom.session import work_path
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLE = "/root/testdata/sf0.001/{}.parquet"


def documents(spark, rows, schema=DOCS):
    rows = [(*r, "en", "s", 0)[: len(schema.split(","))] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(rows, schema)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- chat ---------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, input_ids string"


def test_chat_reads_back_what_was_written(spark):
    rows = [
        (1, 0, "user", "hello <s> [INST]", "x"), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x"),
        (2, None, None, None, None), (2, 3, "assistant", "", None), (2, 4, "assistant", "né\u00a0 \n<\\s> <|turn|>", None),
        (2, 4, "assistant", "né\u00a0 \n<\\s> <|turn|>", None), (None, 0, "assistant", "a" * 50_000, None),
    ]
    formatted = chat.format_conversations(spark.createDataFrame(rows, CHAT))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert len(got) == 3
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    strings = [r.string for r in chat.rendered(formatted).collect()]
    assert sum(map(len, strings)) == sum(r.formatted_chars for r in got.values())
    # Marks occur where the template puts them and nowhere else.
    assert sum(s.count("</s>") for s in strings) == len(rows) and not any("[INST]" in s for s in strings)


def test_chat_masks_are_offsets_of_assistant_contents(spark):
    rows = [(1, 0, "user", "one two", ""), (1, 1, "assistant", "three four", "")]
    out = chat.format_conversations(spark.createDataFrame(rows, CHAT)).orderBy("turn").collect()
    assert sum(out[0].loss_mask) == 0 and out[1].token_start == len(out[0].input_ids)
    own = chat.codec(chat.VOCABULARY, chat.Template())
    ids = np.array(out[1].input_ids)
    assert own.decode(ids[np.array(out[1].loss_mask, bool)]) == "three four"


def test_chat_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CHAT))).count() == 0


def test_chat_long_segments_are_encoded_as_wholes():
    own, rng = chat.codec(chat.VOCABULARY, chat.Template()), random.Random(1)
    parts = ["word", " ", "  ", "\n", "don't", "\u3042\u3044", "\n  ", "9", "!?", "x" * 9000]
    texts = ["q" * 50_000, " " * 50_000 + "x", "a b" * 9000 + " " * 60_000 + "c", "\u3042" * 60_000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(100, 9000))) for _ in range(20)]
    assert all(own.encode(t) == own.base.encode_ordinary(t) for t in texts)
    for text in (" " * 1_000_000, "\n" * 300_000 + "end"):  # more than the tokenizer itself can take
        assert own.decode(np.array(own.encode(text))) == text


def test_escaping_is_reversible():
    t, rng = chat.Template(), random.Random(3)
    parts = ["<", "s>", "/", "\\", "[", "INST]", "|", "<s>", "</s>", "[/INST]", "\\\\", "im_start|>", "x"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert t.unescaped(t.escaped(s)) == s
        assert not any(c in t.escaped(s) for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template(others=("<<SYS>>",))


# --- quality ------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01/{}.parquet"
    docs, labels = (spark.read.parquet(folder.format(t)) for t in ("documents", "labels"))
    x = quality.with_statistics(docs)
    scored = quality.score_statistics(x, quality.train(docs, labels, x)).join(labels, "doc_id").where(quality.held_out())
    rows = scored.select("score", "quality").collect()
    assert sum((r.score >= 0.3) == r.quality for r in rows) >= 0.97 * len(rows)


def test_quality_scores_equal_a_plain_discriminant(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(5, 120)) + rng.choice([".", "!!! $$", "\nX Y Z\n"]) * rng.randint(1, 9) for _ in range(300)]
    docs = documents(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int("!" not in t or i % 7 == 0)) for i, t in enumerate(texts)], "doc_id long, quality int")
    x = quality.with_statistics(docs)
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_statistics(x, model).collect()}
    v = np.array([quality.statistics(t.encode()) for t in texts])
    own = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    y = np.array([int("!" not in texts[i] or i % 7 == 0) for i in own])
    center, scale = v[own].mean(0), np.sqrt(np.maximum(v[own].var(0), 1e-6))
    length = np.expm1(v[:, :1])
    z = np.arcsinh((v[:, 1:] - center[1:]) / scale[1:] * length / (length + quality.EVIDENCE))
    cov = [np.cov(z[own][y == k].T, bias=True) for k in (0, 1)]
    common = (cov[0] * (y == 0).sum() + cov[1] * (y == 1).sum()) / len(y)
    density = []
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * common
        c = 0.95 * c + (0.05 * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        away = z - z[own][y == k].mean(0)
        density.append(-0.5 * (np.einsum("ij,ij->i", away, np.linalg.solve(c, away.T).T) + np.linalg.slogdet(c)[1]))
    logit = density[1] - density[0] + np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    plain = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    assert np.allclose([got[i] for i in range(300)], plain, atol=1e-7)


def test_quality_fits_to_a_bounded_sample(spark):
    docs = documents(spark, [(i, "good words here. " * 9 if i % 2 else "!!! $$$ " * 9) for i in range(2000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    model = quality.train(docs, labels, most=200)
    scores = quality.score_statistics(quality.with_statistics(docs), model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in scores)


def test_quality_odd_rows_and_missing_classes(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "a b"), (1, None), (3, "word " * 200_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    scores = [r.score for r in quality.score_statistics(quality.with_statistics(docs), model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert quality.filter_quality(docs, model, 0.0).count() == 5
    assert quality.filter_quality(docs, model, 0.3).columns == docs.columns
    assert quality.filter_quality(documents(spark, []), model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    assert len(quality.train(docs, odd).means) == 0


# --- url filter ---------------------------------------------------------------------------------------------------

RULES = (
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
)


def _plain_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(brute.UPPER), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_url_rules_equal_plain_matching(spark):
    rng = random.Random(1)
    hosts = ["example.com", "WWW.example.com", "a.www.example.com", "xcom", "com", "b.net", "evil.org", "casino.org", "", "é.com"]
    paths = ["", "/", "/en", "/en/x", "/es/y.com/en/", "?q=/en/", "#/", "/en/?a://b.net/es/", "/\x00.com/"]
    urls = [f"{rng.choice(['http', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "http://a.com/" + "x" * 100_000]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for r in url_filter.judge_urls(pages, RULES).collect():
        host, path, rule, verdict = _plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "casino" in host else "allow"))
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def _glob_fits(glob, text):
    reached = {0}
    for c in [*text, None]:
        for i in sorted(reached):
            while i < len(glob) and glob[i] == "*":
                i += 1
                reached.add(i)
        if c is not None:
            reached = {i if glob[i] == "*" else i + 1 for i in reached if i < len(glob) and glob[i] in (c, "?", "*")}
    return len(glob) in reached


def test_globs_equal_plain_matching():
    rng = random.Random(5)
    globs = ["".join(rng.choice("ab*?/") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 50))) for _ in range(200)] + [""]
    # A canonical URL starts with a point; the host glob has to allow for it.
    automaton = url_filter.Automaton([(".", g) for g in globs])
    got = automaton.matches([("", t) for t in texts])
    for j, g in enumerate(globs):
        assert [_glob_fits(g, t) for t in texts] == got[:, j].tolist()


# --- mixing -------------------------------------------------------------------------------------------------------


def test_mixing_equals_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", rng.choice(["é", "b", "b", "b", "a", "Z", None, "tiny"]), 0) for i in range(300)]
    rows += [(1000, words(rng, 3000), "en", "b", 0), (1001, None, None, "empty", None), (1002, "x", "en", "one", 0)]
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows)).collect()}
    plain = brute.taken([(r[0], r[1], r[3]) for r in rows])
    assert got.keys() == plain.keys()
    for d, (size, source_size, target, words_taken) in plain.items():
        assert (got[d]["size"], got[d].source_size, got[d].taken) == (size, source_size, words_taken)
        assert math.isclose(got[d].target, target, rel_tol=1e-9, abs_tol=1e-9)
        assert got[d].taken <= 3 * size


def test_mixing_weights_repeats_and_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = [(i, "a b c d", "en", "s", w) for i, w in enumerate([0, 0, 1, 9] * 50)] + [(7, "a b", "en", "t", 1)] * 3
    out = mixing.mix(documents(spark, rows), weight="n_chars").collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r["size"] for r in out)
    per = {r.source_size: 0 for r in out}
    for r in out:
        per[r.source_size] += r.taken
    goal = {r.source_size: r.target for r in out}
    assert all(abs(per[s] - goal[s]) <= 1 for s in per)


def test_mixing_rates_give_the_missing_words(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 3, 50, 2000]) for _ in range(200)]
    docs = documents(spark, [(i, words(rng, n), "en", "s", 0) for i, n in enumerate(sizes)])
    rows = mixing.measured(docs).cache()
    for missing in (10, 5000, sum(sizes) // 2, sum(sizes) - 3, sum(sizes)):
        plan = mixing.inclusion_rates(rows, spark.createDataFrame([("s", missing)], "s string, missing long")).first()
        p = [min(1.0, plan.rate * n**0.5) for n in sizes]
        assert math.isclose(sum(x * n for x, n in zip(p, sizes, strict=True)), missing, rel_tol=1e-9)
        assert plan.certain == sum(n for x, n in zip(p, sizes, strict=True) if x >= 1)
    rows.unpersist()


def test_mixing_gives_the_documents(spark):
    rng = random.Random(9)
    schema = "doc_id long, text string, source string, n_chars long, copy int, mix_id int, body int"
    rows = [(i, words(rng, rng.randint(0, 90)), rng.choice(["b", "b", "b", "a", None, "tiny"]), 0, 1, 2, 3) for i in range(150)]
    rows += [(None, words(rng, 30), "b", 0, 1, 2, 3) for _ in range(30)] + [rows[3]] * 2 + [(7, "other text of one id", "a", 0, 1, 2, 3)]
    rows += [(1000, words(rng, 60_000), "a", 0, 1, 2, 3), (1001, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    digest = mixing.mix(docs).collect()
    assert len(digest) == len(rows)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == [*docs.columns, "copy_"]
    got, want, texts = {}, {}, {(r[0], r[1] or "") for r in rows}
    for r in copies.collect():
        assert any(d == r.doc_id and t.startswith(r.text) for d, t in texts) and r.n_chars == len(r.text)
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(brute.WORD.findall(r.text))
    for r in digest:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
        assert r.taken <= 3 * r["size"]
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# --- HTML ---------------------------------------------------------------------------------------------------------


def test_minimum_cut_is_least():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.2, 0.7, 1.5])) for _ in range(rng.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(x, scores=scores, edges=edges):
            own = sum(max(0, -s) if k else max(0, s) for s, k in zip(scores, x, strict=True))
            return own + sum(w for a, b, w in edges if x[a] != x[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_text.minimum_cut(scores, edges)), best, abs_tol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div>
<article><header><h1>The &amp; title</h1></header><p>One   paragraph<br>with a <b>bold &lt;word&gt;.</b><p>Another&nbsp;one, 1 < 2.</p>
<div class="ad">Buy now!</div><form><label>Name</label><button>Send</button></form>
<section id="comments"><p>I like what this article says, thanks a lot for it.</p></section></article>
<aside><p>Read this other long article, too, it is good.</p></aside><footer>&copy; somebody</footer></body></html>"""


def test_html_main_text(spark):
    text = "The & title\nOne paragraph with a bold <word>.\nAnother one, 1 < 2."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", PAGE[:450], "x"),
            (None, "u", "<article>" + "<p>Some words in a row.</p>" * 20_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert [r.text for r in out if r.page_id == 1] == [text, text]
    assert [r.text for r in out if r.page_id in (2, 3)] == ["", ""]
    assert [len(r.text.split("\n")) for r in out if r.page_id is None] == [20_000]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def _article(page):
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_html_equals_article_of_given_pages(spark):
    pages = spark.read.parquet(TABLE.format("pages"))
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == _article(r.html)


def test_html_cut_decides_blocks_in_doubt(spark):
    """Without ties some blocks are labelled wrongly; the cut mends them all."""
    alone = dataclasses.replace(html_text.COSTS, neighbour=0.0, sibling=0.0)
    changed, wrong = 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        found = html_text.blocks(r.html)
        scores = [x for _, x, _ in found]
        changed += sum(k != (x > 0) for k, x in zip(html_text.minimum_cut(scores, html_text.ties(found)), scores, strict=True))
        assert html_text.main_text(r.html) == _article(r.html)
        wrong += html_text.main_text(r.html, alone) != _article(r.html)
    assert changed > 0 and wrong > 0
    page = "<article><p>A sentence that is long enough to be content.</p><p>Ok</p><p>Another sentence, as long as the first.</p></article>"
    assert html_text.main_text(page).split("\n")[1] == "Ok" and "Ok" not in html_text.main_text(page, alone)
    table = "<article><p>Its parts are these, one below the other.</p><ul><li>tea</li><li>milk</li></ul><table><tr><td>1</td><td>2</td></tr></table></article>"
    assert html_text.main_text(table).split("\n")[1:] == ["tea", "milk", "1", "2"]
    far = "<div><p>Ok</p></div><article><section><p>A sentence that is long enough to be content.</p></section></article>"
    assert "Ok" not in html_text.main_text(far)


# --- SimHash ------------------------------------------------------------------------------------------------------


def test_covering_masks_cover():
    masks = simhash.covering_masks(list(range(64)), 2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


@pytest.mark.parametrize("large", [4096, 3])
def test_simhash_equals_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(4)
    base = words(rng, 400)
    rows = [(i, words(rng, rng.randint(0, 8))) for i in range(60)]
    for i in range(60, 140):
        own = base.split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(400)] = "zz"
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "ONE Two three"), (204, "one two\nTHREE"), (205, "one two")]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert {d: r.fp & (2**64 - 1) for d, r in got.items()} == {d: brute.fingerprint(t) for d, t in rows}
    assert {d: r.component_id for d, r in got.items()} == brute.near_groups(rows)


def test_simhash_links_of_random_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 8)
    rng = random.Random(9)
    center, values = rng.getrandbits(64), set()
    for _ in range(600):
        values.add(center ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)))
    for v in list(values)[:300]:
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in found)
    assert brute.components(signed, [(r.a, r.b) for r in found]) == brute.components(signed, pairs)


def test_simhash_keeps_one(spark):
    text = "the quick brown fox jumps over it"
    rows = [(3, text), (1, text), (1, text), (2, "something else that is quite unlike it"), (None, text), (1, "no copy of anything here at all"), (None, "alone without id")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, text), (2, rows[3][1]), (1, rows[5][1]), (None, rows[6][1])], key=str)
    assert simhash.keep_one(documents(spark, [])).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_pipeline_stage_links_by_two_bits_and_keeps_the_least_id(spark):
    rng = random.Random(3)
    own = words(rng, 300)
    docs = documents(spark, [(2, own), (1, own.replace(" ", "\n")), (3, words(rng, 300)), (4, "")])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_components_of_a_path_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(3, 3), (100, 90), (90, 100), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 200: 200, 201: 200}


# --- WARC ---------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def _files(folder):
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.base_name.endswith(".gz")]
    return {f.base_name: hashlib.sha256(fs.open_input_stream(f.path).read()).hexdigest() for f in names}


def test_warc_round_trip_and_reruns(spark):
    same, rng = "é" * 60, random.Random(6)
    rows = [(i, f"http://h/{i}", words(rng, 60), "x") for i in range(60)]
    rows += [(70, "http://h/ a\r\nb", same, "x"), (71, None, same, "x"), (72, "u", "short", "x"), (73, "u", "short", "x"),
             (74, "u", None, "x"), (75, "u", "", "x"), (None, "u", same, "x"), (80, "u", "q" * 300_000, "x"), (72, "u", "short", "x")]
    folders = []
    for parts in (1, 5):
        folder = work_path(spark, "test-warc")
        manifest = warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(parts), folder, shard_bytes=6000, file_bytes=1500)
        assert manifest.count() == len(_files(folder)) > 5
        folders.append(folder)
    assert _files(folders[0]) == _files(folders[1])
    got = warc.read_archive(spark, folders[0]).collect()
    assert len(got) == len(rows)
    stored = {r.page_id: r.payload for r in got if r.record_type == "response" and r.page_id is not None}
    for page_id, _, page, _ in rows:
        payload = (page or "").encode()
        for r in (r for r in got if r.page_id == page_id):
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert r.refers_to == (70 if page == same and page_id != 70 else None)
            assert (r.payload if r.record_type == "response" else stored[r.refers_to]) == payload


def test_warc_splits_missing_ids_and_equal_rows(spark):
    rng = random.Random(6)
    rows = [(None, None, words(rng, 80), "k") for _ in range(300)] + [(7, "u", "short", "k")] * 300 + [(i, "v", words(rng, 80), "k") for i in range(100, 200)]
    folder = work_path(spark, "test-warc")
    manifest = warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(5), folder, shard_bytes=20_000).collect()
    per_shard = {}
    for r in manifest:
        per_shard[r.shard] = per_shard.get(r.shard, 0) + r.records
    assert sum(per_shard.values()) == 700 and max(per_shard.values()) <= 1.5 * 20_000 / warc.HEAD_BYTES
    read = warc.read_archive(spark, folder)
    assert read.count() == 700 and read.select(F.spark_partition_id().alias("p")).distinct().count() > len(manifest) // 2
    assert read.where("page_id IS NULL").count() == 300 and read.where("page_id = 7").count() == 300


def test_warc_empty_table(spark):
    folder = work_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None, warc.DATE)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


# --- line dedup ---------------------------------------------------------------------------------------------------


def test_line_dedup_equals_plain_version(spark):
    rng = random.Random(8)
    lines = [words(rng, 6) for _ in range(25)] + ["short", "", "  "]
    rows = []
    for i in range(80):
        own = [rng.choice(lines) for _ in range(rng.choice([0, 1, 5, 200]))]
        rows.append((i, "\n".join(rng.choice([x, x.upper(), f"\t{x} "]) for x in own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "É" * 25 + "\nx"), (104, "É" * 25), (105, "é" * 25), (106, "É" * 25)]
    docs = documents(spark, rows, "doc_id long, text string, pos string, kept string, h1 string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    got = {x["doc_id"]: (x["lines"]["n_lines"], x["lines"]["n_dropped"], x["lines"]["kept"]) for x in out.collect()}
    assert got == brute.line_dedup(rows)
    assert out.columns == [*docs.columns, "lines"]


def test_helper_columns_never_clash(spark):
    names = ["lines", "lines_doc", "lines_body", "lines_words", "lines_dense", "kept_id", "kept_body", "body", "fp", "__id", "__doc"]
    line = "a line that is long enough to count"
    rows = [(i, line, *range(len(names))) for i in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: (r.text, r.lines) for r in out.collect()} == {1: ("", 0), 2: ("", 0), 3: (line, 0)}
    kept = simhash.keep_one(docs).collect()
    assert [tuple(r) for r in kept] == [rows[0]]


def test_line_dedup_repeated_and_missing_ids(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (1, f"{line}\nother"), (None, line), (None, f"x\n{line}"), (2, f"{line}\ny")]
    out = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()), key=str)
    assert out == sorted([(1, ""), (1, ""), (1, "other"), (None, ""), (None, "x"), (2, f"{line}\ny")], key=str)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_runs_no_python(spark):
    docs = documents(spark, [(1, "x")])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- embeddings ---------------------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    near = np.repeat(base[:12], 25, 0) + rng.normal(size=(300, 24)) * 0.12
    x = np.concatenate([base, near, base[:5], base[:5] * 7]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, x[0][:12].tolist()]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    vectors = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, node int, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.linked_vectors(vectors).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(unit @ unit.T >= 0.9)
    pairs = [(int(i), int(j)) for i, j in zip(a, b, strict=True) if i != j]
    comp = brute.components(range(len(x)), pairs)
    true = np.bincount([i for i, _ in pairs], minlength=len(x))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * true.sum()
    assert all(got[i].n_links <= true[i] for i in range(len(x)))
    assert sum(got[i].component_id != comp[i] for i in range(len(x))) == 0
    for i, _ in rows[len(x) :]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embedding_group_wider_than_the_beam(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * 0.02
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = embedding_dedup.linked_vectors(vectors, embedding_dedup.Search(beam=8)).collect()
    assert {r.n_links for r in out} == {899} and {r.component_id for r in out} == {0}


def test_embedding_links_missed_from_one_end_are_searched_again(spark):
    schema = "dim int, home long, shard long, a long, b long, n long"
    # Rows without a: links to greater nodes, and to lesser ones. 0 and 1 agree; 2 found one link in 0 that 0 did not find.
    rows = [(8, 0, 1, None, 5, 3), (8, 1, 0, None, 3, 5), (8, 2, 0, None, 1, 0), (8, 0, 2, None, 0, 0), (8, 1, 1, None, 4, 4),
            (8, 2, 2, None, 4, 3), (8, 1, 2, None, 1000, 0), (8, 2, 1, None, 0, 995), (8, 0, 1, 7, None, 9)]
    found = embedding_dedup._uneven(spark.createDataFrame(rows, schema), 0.98)
    assert sorted(map(tuple, found.collect())) == [(8, 0, 2), (8, 2, 0), (8, 2, 2)]


def test_embedding_rare_links_are_found(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 12))
    x[2000:2040] = x[:40] + rng.normal(size=(40, 12)) * 0.05
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(x)
    got = embedding_dedup.linked_vectors(vectors, embedding_dedup.Search(beam=4, audited=4, audited_share=10**6)).collect()
    assert sum(r.n_links for r in got) >= 0.98 * true > 80


def test_embedding_graphs_and_searches_have_tasks_of_their_own(spark, monkeypatch):
    written = {}
    kept = embedding_dedup.cut_lineage
    monkeypatch.setattr(embedding_dedup, "cut_lineage", lambda df, label: written.setdefault(label, kept(df, label)))
    x = np.random.default_rng(2).normal(size=(400, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    embedding_dedup.linked_vectors(vectors, embedding_dedup.Search(least_shards=5)).collect()
    # Rows of a file come from one task. 5 shards, and 25 searches of which a few may meet by hash.
    tasks = {label: written[label].groupBy(F.input_file_name()).count().count() for label in ("embedding-graphs", "embedding-links")}
    assert tasks["embedding-graphs"] == 5 and tasks["embedding-links"] > 15


def test_embedding_search_scores_a_node_once(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, scored = hnsw.Graph(x), []
    pairs = hnsw.Graph._pair_scores
    monkeypatch.setattr(hnsw.Graph, "_pair_scores", lambda self, q, asked, node: scored.append(asked * len(x) + node) or pairs(self, q, asked, node))
    start = graph._enter(x[:50], 0)
    scored.clear()
    found, score = graph._beam(x[:50], graph.layers[0], start, 32)
    every = np.concatenate(scored)
    assert len(np.unique(every)) == len(every) and not np.isin(np.arange(50)[:, None] * len(x) + start, every).any()
    best = np.sort(x[:50] @ x.T, 1)[:, -10:]
    assert np.isclose(np.sort(score, 1)[:, -10:], best, atol=1e-5).mean() > 0.98 and (found >= 0).all()


def test_embedding_empty_table(spark):
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def test_decontamination_finds_changed_passages(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, words(rng, 40)) for i in range(20)] + [(50, None), (51, ""), (52, "six words make this item short"), (53, words(rng, 300))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    fifth = items[0][1].split()
    fifth[2::5] = ["changed"] * len(fifth[2::5])
    dropped = items[2][1].split()
    del dropped[20]
    rows = [
        (1, words(rng, 100) + " " + items[5][1].upper().replace(" ", ", ") + " " + words(rng, 50)),
        (2, words(rng, 30) + " " + " ".join(fifth)), (3, " ".join(dropped)), (4, words(rng, 500)), (5, None), (6, ""),
        (7, " ".join(items[7][1].split()[:20]) + " " + words(rng, 30)), (8, "x six words make this item short y"),
        (9, " ".join(items[-1][1].split()[100:160])), (1, items[1][1]),
    ]
    expected = [(1, 1), (1, 5), (2, 0), (3, 2), (8, 52), (9, 53)]
    for block in (1 << 18, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = decontaminate.contaminated(documents(spark, rows), bench)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == expected
        clean = decontaminate.remove_contaminated(documents(spark, rows), bench)
        assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("size", [40, 50, 59])
def test_decontamination_counts_changed_words_wherever_they_are(size):
    rng = random.Random(size)
    item = words(rng, size)
    probe = decontaminate.Probe([(1, item)])
    texts = []
    for _ in range(200):
        own = item.split()
        for at in rng.sample(range(size), size // 5):
            own[at] = "changed"
        texts.append(f"{words(rng, 30)} {' '.join(own)} {words(rng, 30)}")
    own = item.split()
    own[4:8] = own[12:16] = ["changed"] * 4
    texts.append(" ".join(own))
    assert all(brute.holds_item(x, [item]) for x in texts)
    assert [len(found) for found in probe.overlaps(texts)] == [1] * len(texts)
    few = item.split()
    few[: size // 5 + 1] = ["changed"] * (size // 5 + 1)
    assert probe.overlaps([" ".join(few)]) == [[]]


@pytest.mark.parametrize("size", [*range(1, 17), 19])
def test_decontamination_finds_short_items_with_any_fifth_changed(size):
    item = [f"w{i}" for i in range(size)]
    probe = decontaminate.Probe([(1, " ".join(item)), (2, "an item of quite other words that is not in any text"), (3, "")])
    texts = []
    for places in itertools.combinations(range(size), size // 5):
        own = ["changed" if i in places else w for i, w in enumerate(item)]
        texts.append(f"before it {' '.join(own)} and after")
    found = probe.overlaps(texts)
    assert found == [[(1, size - size // 5, size, 2 + min(i for i in range(size) if x.split()[2 + i] != "changed"))] for x in texts]
    if size > 1:
        cut = ["changed" if i <= size // 5 else w for i, w in enumerate(item)]
        assert probe.overlaps([" ".join(cut)]) == [[]]


def test_seeds_leave_one_whole_in_items_of_any_length():
    ranges = dict.fromkeys((least, most) for _, least, most in decontaminate.SEEDS)
    assert [a for a, _ in ranges][0] == 1 and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(ranges))
    for least, most in ranges:
        top = min(most, 300)
        seeds = [x for x, *own in decontaminate.SEEDS if own == [least, most]]
        needed = brute.least_changes(seeds, top)
        assert all(needed[n] > n // 5 for n in range(least, top + 1))
        # Any longer item has a stretch of 100 words for every 20 changes, and what is left over is one of the lengths above.
        assert most == top or needed[100] >= 20


@pytest.mark.parametrize("block", [1 << 18, 500])
def test_decontamination_equals_plain_search_for_random_changes(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate([*range(1, 60, 2), 80, 100, 150, 200])]
    items += [(100, items[20][1]), (100, items[20][1]), (None, items[20][1]), (101, "a"), (102, "\u00e9t\u00e9 \u0130x")]
    rows = [(None, None), (-1, ""), (-2, "a"), (-3, "x " * 3000 + "\u00c9T\u00c9, \u0130x")]
    for i, item in items[:34]:
        for times in range(3):
            own = item.split()
            # Of a long item, 50 words would count by themselves: there, none too many are changed.
            for at in rng.sample(range(len(own)), len(own) // 5 + (times // 2 if len(own) < 60 else 0)):
                own[at] = "changed"
            rows.append((i * 10 + times, f"{words(rng, 20)} {' '.join(own)} {words(rng, 20)}"))
    rows += [(7, rows[-3][1]), (7, rows[-3][1]), (None, rows[-3][1])]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, body long")
    expected = sorted(
        ((d, i) for d, text in rows for i, item in items if brute.holds_item(text, [item])), key=lambda x: [(v is None, v or 0) for v in x]
    )
    found = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(found, key=lambda x: [(v is None, v or 0) for v in x]) == expected
    clashing = docs.selectExpr("*", "1 gone_id", "2 AS body", "3 doc", "4 gone_body")
    clean = decontaminate.remove_contaminated(clashing, bench)
    assert clean.columns == clashing.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for _, t in rows if not brute.holds_item(t, [x for _, x in items]))
