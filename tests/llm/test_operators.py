"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ruleweave.llm import components, decontaminate, html_text, language, media, mixing, quality, queries, simhash, substrings, url_filter, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t) if t else None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def table(small):
    return pd.read_parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null values in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(60_000))
    rows = [(1, "one two three four", "en", "a", 4), (1, "one two three four", "en", "a", 4), (2, None, None, None, None), (None, "one two three four", "en", None, 4), (None, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4), (5, long, "en", "b", 1), (6, "Ünï ﬁ ☃ <|endoftext|> a\u0301", "xx", "c", 9)]
    names = ["row", "id", "tie", "fp", "u", "q", "size", "nll", "band", "host", "rule", "kept", "total", "chars", "key", "copies", "value"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(n) for n in names])


def empty(df):
    return df.limit(0)


# Components


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, None), (9, 9)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1 Language identification


def test_language_on_held_out_documents(spark, small, table):
    out = queries.QUERIES["op1_language_id"](spark, small).toPandas().merge(table, on="doc_id")
    assert len(out) == len(table) and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out["held_out"]]
    assert len(held) > 20 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_backs_off_to_shorter_grams(spark, odd):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house of the king", "en"), ("das haus und der könig", "de")] * 5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the")[0] == "en" and model.predict("und")[0] == "de"
    assert model.predict("königin")[0] == "de" and model.predict("kings")[0] == "en"  # unseen words
    assert model.predict("Ж")[1] == 0.5  # nothing known of it: all languages alike
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0)
    got = language.identify(odd, model)
    assert got.count() == odd.count() and {r.lang_pred for r in got.where("doc_id in (2, 3, 4)").collect()} == {"und"}
    nothing = language.train(empty(odd))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty(odd), model).count() == 0


def test_language_against_plain_sums(spark, table, small):
    """Brute force: the backoff scores in dictionaries, for every document."""
    learned = [(r.lang, t) for r in table.itertuples() if r.lang and (t := language.letters(r.text))]
    counts, totals = defaultdict(Counter), Counter()
    for lang, words in learned:
        for n, entry in [(0, w) for w in words] + [(n, g) for w in words for n in language.ORDERS for g in language.grams(w, n)]:
            counts[n, entry][lang] += 1
            totals[lang, n] += 1
    langs = sorted({r.lang for r in table.itertuples() if r.lang and r.text is not None})
    share = lambda n, entry: {x: math.log(counts[n, entry][x] + 0.5) - math.log(totals[x, n] + 1) for x in langs}
    model = language.train(spark.read.parquet(f"{small}/documents.parquet"), train_docs=10**6, sample=10**7)
    for r in table.head(60).itertuples():
        total = dict.fromkeys(langs, 0.0)
        for w in language.letters(r.text):
            parts = [(0, w)] if (0, w) in counts else next(([(n, g) for g in language.grams(w, n) if (n, g) in counts] for n in language.ORDERS if any((n, g) in counts for g in language.grams(w, n))), [])
            for part in parts:
                total = {x: total[x] + v for x, v in share(*part).items()}
        want = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        got, score = model.predict(r.text)
        assert got == (want if language.letters(r.text) else "und")
        assert not score or score == pytest.approx(1 / sum(math.exp(min(0, total[x] - total[want])) for x in langs), rel=1e-3)


# 2 URL filters


def plain_rule(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), re.split("[?#]", rest[n:])[0]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_url_rules(spark, small):
    urls = ["http://a.Example.COM/en/75?x#y", "https://com/en/", "http://notcom/en/", "x.com/en/", None, "", "http://example.net#/de/8", "http://www.example.net/de/81", "s://a.b.net/de/", "http://org:80/es/", "http://x.org/es/a?b=://c", "http:///en/", "http://..com/en/\n9", "HTTP://ÉX.net/de/"]
    got = url_filter.match_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("mine")), url_filter.rule_table(spark)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_rule(u, url_filter.RULES) for i, u in enumerate(urls)}
    pages = pd.read_parquet(f"{small}/pages.parquet")
    got = queries.QUERIES["op2_url_filters"](spark, small).collect()
    assert len(got) == len(pages) and all((r.host, r.path, r.rule, r.verdict) == plain_rule(u, url_filter.RULES) for u, r in zip(pages.sort_values("page_id").url, sorted(got, key=lambda r: r.page_id), strict=True))


def test_url_rules_of_the_contract(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://example.net/de/81", "http://a.org/es/1", "http://a.org/en/1"]
    got = url_filter.match_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark), default="none").collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block", "allow", "allow", "block", "block", "none"]


def test_url_rules_with_ties_and_without_rows(spark):
    urls = spark.createDataFrame([(1, "http://a.b.c/x/y"), (1, "http://a.b.c/x/y"), (None, None)], "page_id long, url string")
    rules = [("b.c", "/x/", "allow"), ("b.c", "/x/", "block"), ("A.B.c", "/x", "allow"), (None, "/x", "block"), ("c", None, "block")]
    got = url_filter.match_rules(urls, url_filter.rule_table(spark, rules))
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in got.collect()) == [("1", "a.b.c/x", "allow")] * 2 + [("None", None, "allow")]
    same = [("b.c", "/x/", "allow"), ("b.c", "/x/", "block")]
    assert url_filter.match_rules(urls, url_filter.rule_table(spark, same)).first().verdict in ("block", "allow")
    assert {r.verdict for r in url_filter.match_rules(urls, url_filter.rule_table(spark, same)).where("page_id = 1").collect()} == {"block"}
    assert url_filter.match_rules(urls, url_filter.rule_table(spark, [])).where("verdict = 'allow'").count() == 3
    assert url_filter.match_rules(empty(urls), url_filter.rule_table(spark)).count() == 0


# 3 Token output


def whole_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_equal_whole_encoding(spark, small, table, monkeypatch):
    table = table.sort_values("doc_id")
    want, start = {}, 0
    for i, ids in zip(table.doc_id, whole_ids(table.text.where(table.text.notna(), None)), strict=True):
        ids = np.array([*ids, 1], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = queries.QUERIES["op3_token_output"](spark, small).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_word_encoder_on_odd_texts():
    import public_tokenizers

    e = wavelet.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    parts = ["don't", "it's", "a\u0301b", "\u0301x", "É", "İstanbul", "ﬁn", "x\u00a0y", "z\u2028w", "12ab", "ab12", "!!", "word,", "ΣΑΣ", "<|endoftext|>", "a<|startoftext|>b", "\t", "\n", "  ", "日本語", "ß", "Ǆ", "e\u0301", "_a_", "\x85", "'re", "ab're", "É\u0301"]
    texts = ["".join(rng.choice([*parts, " ", "\n"]) for _ in range(40)) for _ in range(300)] + ["", None, " ", "\n"]
    assert [np.frombuffer(r, e.kind).tolist() for r in e.encode(texts)] == whole_ids(texts)
    e.memo, e.older = {}, e.memo  # a full memo starts a new generation
    assert [np.frombuffer(r, e.kind).tolist() for r in e.encode(texts)] == whole_ids(texts)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 9)
    m = wavelet.WaveletMatrix.from_row(m.n, 9, m.zeros.tolist(), m.planes.tobytes(), m.ranks.tobytes())
    assert (m.ids() == ids).all()
    assert [m.access(i) for i in range(0, n, 41)] == ids[::41].tolist()
    for t in (0, 5, 299, 511):
        at = np.nonzero(ids == t)[0].tolist()
        assert m.count(t) == len(at) and [m.occurrence(t, k) for k in range(len(at))] == at
        assert m.count(t, n // 2) == sum(i < n // 2 for i in at)
    assert m.count(512) == m.count(-1) == 0


def test_shards_count_and_find(spark, odd, monkeypatch):
    import public_tokenizers

    from ruleweave.llm.common import materialize

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = materialize(wavelet.encode_shards(odd, path), "test-shards")
    got = wavelet.read_documents(shards).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == sum(len(i) + 1 for i in whole_ids([r.text for r in rows]))
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[:-2] == sorted(order[:-2]) and order[-2:] == [None, None]  # null ids come last
    every = [i for ids in whole_ids([r.text for r in rows]) for i in [*ids, 1]]
    common = Counter(every).most_common(1)[0][0]
    assert {r.token: r.n for r in wavelet.count_tokens(shards, [1, common, 40000]).collect()} == {t: every.count(t) for t in (1, common, 40000)}
    assert sorted(r.position for r in wavelet.occurrences(shards, 1).collect()) == sorted(r.start + r.n_tokens - 1 for r in got)
    assert wavelet.token_documents(empty(odd), path).count() == 0


# 4 Substring dedup


def brute_removal(rows):
    """n_words, n_removed and kept text by the definition."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings_of_documents(spark, small, table):
    got = queries.QUERIES["op4_substring_dedup"](spark, small).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal([(i, t) for i, t in zip(table.doc_id, table.text, strict=True)])


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_patchworks(spark, seed):
    """Passages cut from each other at all lengths and offsets, few words, repeats inside a document."""
    rng = random.Random(seed)
    base = [[rng.choice("ab cde fgh ij klm no".split()) + str(rng.randrange(3)) for _ in range(60)] for _ in range(4)]
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            a = rng.randrange(50)
            words += b[a : a + rng.randrange(5, 30)] + [f"u{rng.randrange(99)}"] * rng.randrange(2)
        texts.append(" ".join(words))
    rows = [(rng.randrange(60), t) for t in texts] + [(99, "x " * 30), (100, "x " * 40), (101, "x " * 12), (None, texts[0]), (5, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.deduplicate(df)
    assert sorted(map(tuple, substrings.digest(found).collect()), key=str) == brute_removal(rows)
    own = defaultdict(list)
    for i, t in rows:
        own[i].append((t or "").split())
    inside = lambda part, whole: any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))
    for r in found.where("size(factors) > 0").collect():
        assert all(f.length >= 13 and f.ref < r.doc_id for f in r.factors)
        # Each factor stands word for word in its reference.
        assert any(all(any(inside(w[f.start : f.start + f.length], x) for x in own[f.ref]) for f in r.factors) and len(w) == r.n_words for w in own[r.doc_id])


def test_factors_are_longest_and_verified():
    ref = [b"x%d" % k for k in range(300)]
    blocks = {(1, 7, b): ref[b * 64 : b * 64 + 76] for b in range(5)}
    doc = [b"new"] * 5 + ref[20:250] + [b"end"] + ref[40:60]
    run = lambda *v: tuple(np.array(x) for x in v)
    # The index knows each window once, with its place in the reference; a place may lead over several blocks.
    runs = run([5], [218], [1], [(7 << 32) + 20])
    assert substrings.parse(doc, runs, blocks) == [(5, 230, 1), (236, 20, 1)]
    # A window of which only the hash is the same begins no factor.
    wrong = {k: [b"y"] * 76 for k in blocks}
    assert substrings.parse(doc, runs, wrong) == [] == substrings.parse(doc, runs, {})


def test_substrings_edge_cases(spark, odd):
    got = sorted(map(tuple, substrings.digest(substrings.deduplicate(odd)).collect()), key=str)
    assert got == brute_removal([(r.doc_id, r.text) for r in odd.collect()])
    assert substrings.deduplicate(empty(odd)).count() == 0


# 5 HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site</header><!-- note --><div class="ad">Buy</div>%s<div id="comments"><p>nice</p></div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A&amp;B</h1><p><b>One\n two.<br><p>Three &lt;i&gt;</p></article>", ["A&B", "One two.", "Three <i>"]),
        ("<article><header><h1>H</h1></header><p>a<i>b</i>c</p><aside>s</aside><form>f</form><ul><li>x<li>y</ul></article>", ["H", "abc", "x", "y"]),
        ("<main><div>left <p>in</p> right</div></main>", ["left", "in", "right"]),
        ("<div class=post><p>only</p></div>", ["only"]),
        ("<article><p>a &amp &am b</p><div class='cookie-notice'>c</div><p>cut <b", ["a & &am b", "cut"]),
        ("<article></article>", []),
        ("<div class='layout has-sidebar'><article class='post comments-open'><p>in</p></article><div class='side-bar sidebar'>x</div></div>", ["in"]),
        ("<article><p>text</p></article><div class=comments><article class=comment><p>me too</p></article></div>", ["text"]),
        ("<div class='adBanner'>x</div><div class='address'><p>kept</p></div>", ["kept"]),
    ],
)
def test_main_text(body, want):
    assert html_text.main_text(PAGE.split("%s")[0] + body + ("" if body.endswith("<b") else PAGE.split("%s")[1])) == "\n\n".join(want)


def test_wrappers_tell_template_from_slots():
    pages = [f"<body><div class=top>Daily News</div><div class=x><div class=story><p>Story {i} text that is long enough</p><p>More {i} of it</p></div><div class=hint>Read us daily</div></div></body>" for i in range(5)]
    template, root = html_text.induce(pages)
    # Constants are kept with their text; the one node of the root holds the story.
    want = {("/body/div.top", "Daily News"), ("/body/div.x/div.hint", "Read us daily")}
    assert set(template) == {html_text.signed(html_text.Node("", html_text.path_key(p), text=[t]).constant()) for p, t in want}
    assert root == html_text.signed(html_text.path_key("/body/div.x/div.story"))
    assert html_text.main_text(pages[3].replace("3", "9"), template, root) == "Story 9 text that is long enough\n\nMore 9 of it"
    # The same place with another text is a slot; slots outside the root are content as well.
    assert html_text.main_text(pages[3].replace("Daily News", "Lead"), template, root).startswith("Lead\n\nStory 3")
    assert html_text.induce(pages[:1])[0] == [] and html_text.induce([pages[0]] * 5)[0] == []  # copies say nothing


def plain_matching(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_matching(x, y))
    return m[-1][-1] + 1


def test_matching_is_best():
    rng = random.Random(3)

    def grow(depth):
        return html_text.Node(rng.choice("abc"), children=[grow(depth - 1) for _ in range(rng.randrange(5))] if depth else [])

    for _ in range(200):
        a, b = (html_text.Node("r", children=[grow(3) for _ in range(4)]) for _ in range(2))
        matcher = html_text.Matcher()
        matcher.name(a)
        matcher.name(b)
        got = matcher.pairs(a, b)
        assert len(got) == plain_matching(a, b) and all(x.label == y.label for x, y in got)
        assert len({id(x) for x, _ in got}) == len({id(y) for _, y in got}) == len(got)


def test_constants_inside_the_article_stay():
    story = "<article><h2>Introduction</h2><p>Text {i} and more of it</p><div class='share-of-market'>Shares {i}</div><div id='related-work'>Work {i}</div><p class='notice-period'>A month {i}</p><math><mi>x</mi></math><h3>Summary</h3></article>"
    pages = [f"<body><div class=top>Daily News</div>{story.format(i=i)}<div class='social-share'>Share {i}</div></body>" for i in range(6)]
    template, root = html_text.induce(pages)
    want = ["Introduction", "Text 4 and more of it", "Shares 4", "Work 4", "A month 4", "x", "Summary"]
    assert html_text.main_text(pages[4], template, root) == "\n\n".join(want) == html_text.main_text(pages[4])
    # Without an article element the content root does the same.
    pages = [p.replace("<article>", "<div class=story>").replace("</article>", "</div>") for p in pages]
    template, root = html_text.induce(pages)
    assert html_text.main_text(pages[4], template, root) == "\n\n".join(want)
    other = pages[4].replace("Introduction", "Overture")
    assert html_text.main_text(other, template, root) == "\n\n".join(["Overture", *want[1:]])


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a href='" * 120_000, '<a ="' * 200_000, "<" * 1_000_000, "<b>" * 100_000 + "<hr>" * 100_000, "<div>" * 5000 + "</x>" * 200_000, "<script>" * 120_000, "<!--" * 250_000, "</" * 500_000, "&" * 1_000_000])
def test_hostile_markup_takes_linear_time(html):
    start = time.time()
    html_text.main_text("<p>a</p>" + html)
    assert time.time() - start < 20


def test_deep_and_wide_pages_of_one_host(spark):
    deep = ["<div>" * 5000 + f"deep {i}" + "</div>x" * 5000 for i in range(3)]
    wide = ["".join(f"<p class={'abc'[(i * k) % 3]}>w {i} {k}</p>" for k in range(2000)) for i in range(4)]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(deep + wide)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1].startswith("deep 1") and all(got[3 + i].split("\n\n") == [f"w {i} {k}" for k in range(2000)] for i in range(4))


def test_extraction(spark, small):
    pages = pd.read_parquet(f"{small}/pages.parquet")
    got = queries.QUERIES["op5_html_extraction"](spark, small).toPandas().set_index("page_id")
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    import html

    for r in pages.itertuples():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", "\n"))).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert got.text[r.page_id] == "\n\n".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None), (None, "x", ""), (2, "http://h/", "<p>a"), (2, "http://h/", "<p>a"), (3, "http://h/", "<div>" * 3000 + "deep " * 9)], "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("template", F.lit("z"))
    assert sorted((str(r.page_id), r.text) for r in html_text.extract(odd).collect()) == [("1", ""), ("2", "a"), ("2", "a"), ("3", " ".join(["deep"] * 9)), ("None", "")]
    assert html_text.extract(empty(odd)).count() == 0


# 6 Decontamination


def brute_leaks(rows, items):
    norm = lambda t: re.sub(r"[^\w\s]|_", " ", t.lower()).split() if t else []
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = set()
    for i, t in rows:
        w = norm(t)
        for j, item in items:
            v = norm(item)
            if v and len(v) < 5:  # a short item is its only shingle
                out |= {(i, j, s, 1.0) for s in [s for s in range(len(w)) if w[s : s + len(v)] == v][:1]}
            if len(v) < 5 or len(w) < 5:
                continue
            n, c, best = min(len(v), len(w)), grams(v), None
            for s in range(len(w) - n + 1):
                x = grams(w[s : s + n])
                m = sum((x & c).values())
                sim = m / (sum(x.values()) + sum(c.values()) - m)
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = (s, sim)
            if best:
                out.add((i, j, best[0], round(best[1], 9)))
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(30))
    items = [(j, " ".join(word() for _ in range(rng.randrange(3, 60)))) for j in range(12)] + [(50, None), (51, ""), (52, "too short")]
    rows = []
    for i in range(60):
        item = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(item))
            item[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append((i, " ".join([*[word() for _ in range(rng.randrange(40))], *item, *[word() for _ in range(rng.randrange(40))]]).replace(" ", rng.choice([" ", ", ", "\n"])).upper()))
    rows += [(100, None), (101, ""), (None, items[0][1]), (3, rows[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench)
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in got.collect()} == want and len(want) > 15
    left = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {w[0] for w in want}


def test_leaks_in_blocks_and_empty_tables(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "nothing like this in any of them"), (3, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 1), (1, 3)]
    assert decontaminate.clean(odd, bench).count() == odd.count() and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.leaks(docs, empty(bench)).count() == decontaminate.leaks(empty(docs), bench).count() == 0
    assert decontaminate.clean(docs, empty(bench)).count() == 2


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 256, 8).astype(np.uint8)
        bits = np.zeros(64, np.uint8)
        bits[rng.permutation(64)[: decontaminate.RADIUS]] = 1
        b = a ^ np.packbits(bits)
        assert any(decontaminate.NEAR[x, y] for x, y in zip(a, b, strict=True))


# 7 Media


def test_media_round_trip(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    got = media.media_features(media.media_files(odd)).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted(map(str, want)) == sorted(str(tuple(g[:5])) for g in got)
    for g in got:
        assert g.codec == "ipcm" and g.duration == g.payload_bytes / 8000 and len(g.keyframes) == -(-g.payload_bytes // 4096)
    assert media.media_features(media.media_files(empty(odd))).count() == 0


def test_walk_reads_other_files():
    """Sizes per sample, several runs of chunks, 64-bit boxes and no sync table: every sample is then a keyframe."""
    table = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)),
        media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
        media.full(b"stsz", struct.pack(">II3I", 0, 3, 4, 6, 8)),
        media.full(b"co64", struct.pack(">I2Q", 2, 1000, 2000)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 25, 25, 0, 0))
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    data = wide + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", table)))) + struct.pack(">I4s", 0, b"mdat") + b"zz"
    t = media.tables(data)
    assert (t["codec"], t["timescale"], t["duration"], t["samples"]) == ("avc1", 25, 25, 3)
    assert t["keyframes"] == [(1000, 4), (1004, 6), (2000, 8)] and t["chunks"] == [(1000, 10), (2000, 8)]
    for bad in (b"", b"text", b"\0\0\0\x08moov", data[:60], b"\0\0\0\x02abcdefgh"):
        assert media.tables(bad)["codec"] is None


def test_damaged_media_have_no_codec():
    rng = random.Random(5)
    sound = media.store(media.pad(b"text " * 900))
    front = sound.index(b"mdat")
    want = media.tables(sound)
    for _ in range(4000):
        data = bytearray(sound)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(front)] = rng.choice([0, 1, 2, 127, 128, 255, rng.randrange(256)])
        got = media.tables(bytes(data[: rng.choice([len(data), front + 100])]))
        assert got.keys() == want.keys() and (got["codec"] is not None or not got["chunks"])
        assert got["samples"] <= len(data)
    nested = b"".join(struct.pack(">I4s", 8 * (50_000 - i), b"moov") for i in range(50_000))
    assert media.tables(nested)["codec"] is None and media.tables(b"") == media.tables(nested)


# 8 SimHash


def brute_simhash(rows):
    def fp(t):
        w = [x.lower() for x in (t or "").encode().split()]
        if not w:
            return 0
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        c = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                c[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * c[b] > len(shingles))

    return [(i, fp(t)) for i, t in rows]


def classes(prints):
    n, parent = len(prints), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(n):
        least[find(k)].append(prints[k][0])
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(n)]


def test_near_duplicates_of_documents(spark, small, table):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash_near_dedup"](spark, small).collect()}
    prints = brute_simhash(list(zip(table.doc_id, table.text, strict=True)))
    assert got == {i: (f"{fp:016x}", c) for (i, fp), c in zip(prints, classes(prints), strict=True)}


def test_close_pairs_in_dense_and_sparse_places(spark, monkeypatch):
    """Large keys are linked by hubs, small ones by pairs: the same classes either way."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    prints = sorted(near | {rng.getrandbits(64) for _ in range(200)} | {0, 3, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = classes(list(zip(signed, prints, strict=True)))
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    for limit in (1, 32, 10_000):
        monkeypatch.setattr(simhash, "SMALL", limit)
        got = {r.node: r.component for r in components.connected_components(simhash.close_pairs(nodes), "a", "b").collect()}
        assert [got.get(s, s) for s in signed] == want


def test_near_duplicates_edge_cases(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    prints = brute_simhash([(r.doc_id, r.text) for r in rows])
    want = sorted(((i, fp - (1 << 64) if fp >> 63 else fp, c) for (i, fp), c in zip(prints, classes(prints), strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "None", "None"]
    assert simhash.near_duplicates(empty(odd)).count() == simhash.keep_one(empty(odd)).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(4000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_simhash([(0, text)])[0][1]


# 9 Quality


def brute_model(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney in dictionaries; gives p(char, history)."""
    levels = {order: Counter()}
    for t in texts:
        s = quality.START + quality.marked(t)
        levels[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts, hist = {}, {}
    for n, level in levels.items():
        k = [sum(c == i for c in level.values()) for i in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        d = [i - (i + 1) * y * k[i + 1] / k[i] if y is not None and k[i] else None for i in (1, 2, 3)]
        cuts[n] = [x if x is not None and 0 < x < i else i / 2 for i, x in zip((1, 2, 3), d, strict=True)]
        hist[n] = defaultdict(lambda: [0, 0.0])
        for g, c in level.items():
            hist[n][g[:-1]][0] += c
            hist[n][g[:-1]][1] += cuts[n][min(c, 3) - 1]

    def p(c, h):
        n = len(h) + 1
        low = 1 / (len(levels[1]) + 1) if n == 1 else p(c, h[1:])
        if h not in hist[n]:
            return low
        total, kept = hist[n][h]
        count = levels[n].get(h + c, 0)
        return (count - cuts[n][min(count, 3) - 1] if count else 0) / total + kept / total * low

    return p


def test_model_against_dictionaries(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "abc", "bca", "cab.", "aa", "aa"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    p = brute_model(texts)
    new = ["abc cab. zz ab", "aa aa aa aa", "", "cab", "q\nab ab", texts[0]]
    want = []
    for t in new:
        s = quality.START + quality.marked(t)
        want.append(-sum(math.log(p(c, "" if c == quality.MARK else s[i - 4 : i])) for i, c in enumerate(s) if i >= 4) / len(s[4:]) if t else None)
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(new)] + [(90, "abc", "xx"), (91, None, "en")], "i long, text string, lang string")
    for shards in (4_000_000, 40):
        quality.SHARD_ENTRIES, before = shards, quality.SHARD_ENTRIES
        model = quality.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
        quality.SHARD_ENTRIES = before
        assert (len(model.shards) > 1) == (shards == 40)
        got = {r.i: r.nll for r in quality.score(rows, model).collect()}
        assert got[90] is None and got[91] is None
        assert [got[i] for i in range(len(new))] == [None if w is None else pytest.approx(w, rel=1e-4) for w in want]


def test_quality_of_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op9_quality_classifier"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert got[(got.quality == 0)].keep.mean() < 0.05
    assert got[(got.quality == 1) & (got.toxic == 0)].keep.mean() > 0.97


def test_quality_edge_cases(spark, odd, small):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, 0), (5, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.select("row.*").columns == odd.columns
    assert {r.row.doc_id for r in got.where("nll is null").collect()} >= {2, 3, 6}
    assert quality.classify(odd, empty(labels)).where("keep").count() == odd.count()
    assert quality.classify(empty(odd), labels).count() == 0


# 10 Mixing


def sql(con_tables, text):
    con = duckdb.connect()
    for name, frame in con_tables.items():
        con.register(name, frame)
    return con.execute(text).df()


@pytest.mark.parametrize("seed", range(2))
def test_mix_equals_sql(spark, seed):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.05 else "w " * int(rng.paretovariate(0.7) % 900), rng.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(400)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    want = sql({"documents": frame}, mixing.ORACLE)
    a, b = got.sort_values("doc_id").reset_index(drop=True), want.sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert (a.taken <= 2 * a["size"]).all() and (a.target <= 2 * a.source_size).all()
    src = frame.merge(a, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((src.taken - src.target).abs() <= src.most / 2 + 1e-6).all()
    assert a.target.groupby(frame.source.fillna("~")).first().sum() == pytest.approx(1.5 * a["size"].sum())


def test_mix_edge_cases(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    want = defaultdict(int)
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in want.items() if n}
    assert mixing.mix(empty(odd)).count() == mixing.mixed_documents(empty(odd)).count() == 0


def test_native_operators_use_no_python(spark, small):
    for name in ("op2_url_filters", "op10_mixing"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
