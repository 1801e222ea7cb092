"""Each operator against a plain version of itself, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from html.parser import HTMLParser
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from clauseworks.llm import bpe, html_text, language, licenses, mixing, near_duplicates, nearest, quality, shingles, token_files, url_filter
from clauseworks.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the a of and river stone house winter bright over under quick slow green tall small water fire earth wind".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


LONG = prose(30_000, 99)
ODD = [None, "", "   \n\t ", "one", "two words", prose(12, 1), prose(12, 1), prose(200, 2), "Ünïcödé テスト 🎉", "x" * 5000, "a\x00b", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2"][i % 3], 0) for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "a row without an id", "en", "s1", 0), (3, "an id that comes twice", "en", "s1", 0)]
    # a column that clashes with names that the operators use
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1 language


def plain_phrases(text, sample):
    codes = language.fold(text).tobytes().decode("utf-16-le")
    count = 0
    for a in range(0, len(codes), language.BLOCK):
        block = codes[a : a + language.BLOCK]
        i = 0
        while i < len(block):
            n = 1
            while i + n <= len(block) and block[i : i + n] in sample:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def test_phrases_are_those_of_a_plain_parse():
    samples = {"a": prose(300, 3).lower(), "b": "der die das und nicht mit einem haus im winter " * 20}
    samples = {k: language.fold(v).tobytes().decode("utf-16-le") for k, v in samples.items()}
    parser = language.Parser(samples)
    texts = [prose(50, 4), "das haus im winter", "zzz qqq", "x", prose(700, 5), "日本語のテキスト", "é" * 3000]
    got = parser.phrases([language.fold(t) for t in texts])
    assert got.tolist() == [[plain_phrases(t, samples[k]) for k in ("a", "b")] for t in texts]


def test_language_is_told_on_held_out_texts(spark):
    en, de = "the and of house river with that from over winter".split(), "der und die haus fluss mit das von über winter".split()
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(en if i % 2 else de) for _ in range(40)), "en" if i % 2 else "de") for i in range(400)]
    out = language.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(x["lang_pred"] == want[x["doc_id"]] and 0.5 < x["score"] <= 1 for x in out)
    assert {x["doc_id"]: x["held_out"] for x in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in want}


def test_language_on_odd_rows(odd, none):
    out = language.predictions(odd).collect()
    assert len(out) == odd.count()
    for x in out:
        text = ODD[x["doc_id"]] if x["doc_id"] is not None and x["doc_id"] != 3 else "letters"
        assert (x["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language.predictions(none).count() == 0
    assert language.known_language(odd).columns == odd.columns
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predictions(unlabelled).collect()} == {"und"}


# 2 html


def test_html():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside>Side</aside><article><h1>Head &amp; more</h1><p>First <b>bold</b>word\n text<br>next</p><p>x</article>"
        "<section id='comments'><p>Nice, thank you for this long and thoughtful article about it all.</p></section><script>var a='</p>';</script><footer>&copy; F</footer>"
    )
    assert html_text.main_text(page) == "Head & more First boldword text next x"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<p>Hello", "Hello"), ("<div><p>a<p>b</div>", "a b"), ("a < b", "a < b"),
        ("<nav>menu<article><p>Body text</p></article>", "Body text"), ("<!-- x --><p>y", "y"), ("<p>&#228;&nbsp;&lt;b&gt;</p>", "ä <b>"), ("<", "<"), ("<a href='x>y", "<a href='x>y"), ("<div class=no-sidebar><p>All of it</p></div>", "All of it"),
    ],
)
def test_html_edges(page, text):
    assert html_text.main_text(page) == text


def test_html_without_an_article_keeps_the_dense_part():
    body = "".join(f"<p>{prose(30, i)}</p>" for i in range(5))
    page = "<div><a href=1>one</a><a href=2>two</a></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>" + body + "<div class='footer'>end</div>"
    assert html_text.main_text(page) == " ".join(prose(30, i) for i in range(5))


@pytest.mark.parametrize("end", ["", "</head>"])
def test_html_head_may_stay_open(end):
    page = f"<html><head class=ad><meta charset=utf-8><title>x</title><style>p{{}}</style><script>s</script>{end}<body><article><p>Body text</article>"
    assert html_text.main_text(page) == "Body text"
    assert html_text.main_text(page.replace("article", "div")) == "Body text"


LONG = "".join(f"<p>{prose(30, i)}</p>" for i in range(5))
WHOLE = " ".join(prose(30, i) for i in range(5))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div id=content>{LONG}</div><aside><article>teaser</article></aside>", WHOLE),
        (f"<article>{LONG}</article><div class='post-comments'><ul><li><article>I like it</article><li class=comment><article>So do I</article></ul></div>", WHOLE),
        (f"<nav>menu<article>{LONG}</article><aside>x</aside><nav>end</nav>", WHOLE),
        (f"<aside>side<article>{LONG}</article>", WHOLE),
        (f"<form id=page><article>{LONG}</article></form>", WHOLE),
        (f"<div class=has-sidebar><article>{LONG}</article></div><p>Skip it</p>", WHOLE),
        (f"<article>{LONG}</article><div><p>{prose(30, 9)}</div>", WHOLE),
    ],
)
def test_html_articles_beside_the_main_text(page, text):
    assert html_text.main_text(page) == text


def test_html_text_outside_a_small_article_is_kept():
    page = f"<div id=content>{LONG}</div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><article>teaser</article>"
    assert html_text.main_text(page).startswith(WHOLE)


def test_html_small_stretches_are_kept():
    page = f"<div>{LONG}</div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>{prose(15, 9)}</p>"
    assert html_text.main_text(page) == f"{WHOLE} {prose(15, 9)}"
    page = page.replace(prose(15, 9), f"<article>{prose(3, 9)}</article>")
    assert html_text.main_text(page) == f"{WHOLE} {prose(3, 9)}"


@pytest.mark.parametrize("bad", ["<a", "<div>", "<script ", "<!", "<a '", '<a "', "</p>", "<!--", "<i><div></i>", "<nav><div><article>", "<svg>", "<script></script ", "<p class='a b'>x"])
def test_html_time_is_linear_on_bad_markup(bad):
    began = time.process_time()
    html_text.main_text(bad * 100_000)
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><svg/><p>b</p>", "a b"), ("<svg><text>s</text></svg><p>b", "b"),
        (f"<main>{LONG}<p class='side effects'>pain<div class='promo-code'>X1</div></main>", f"{WHOLE} pain X1"),
        (f"<article>{LONG}<div class=ad>Buy</div><div class=ad>it</div><div class='post-comments'><p>Nice</div><p>x</article>", f"{WHOLE} x"),
        ("<b>one<div>two</b> three</div><a>four<div>five</a> six</div>", "one two three five six"),
    ],
)
def test_html_more_edges(page, text):
    assert html_text.main_text(page) == text


def plain_main_text(html, window, surge):
    """Surge and dive over the same lines, tried at every place."""
    lines = html_text.lines_of(html)
    lines = lines if any(x for _, x, *_ in lines) else html_text.lines_of(html, False)
    share = sum(x for _, x, m, _ in lines if m) / max(1, sum(x for _, x, *_ in lines))
    w = [x + html_text.IN_MAIN if m else max(0, x - math.floor(html_text.OUTSIDE * min(1, 2 * share))) for _, x, m, _ in lines]
    zero = lambda i: not any(w[i : i + window])
    begins = {i for i in range(len(w)) if w[i] and sum(w[i : i + window]) >= surge}
    in_stretch = [any(i in begins and not any(zero(j) for j in range(i, k + 1)) for i in range(k + 1)) for k in range(len(w))]
    kept = [k for k in range(len(w)) if in_stretch[k] and (w[k] or lines[k][3] and not lines[k][1])]
    kept = kept or [k for k in range(len(w)) if lines[k][1]]
    return " ".join(lines[k][0] for k in kept)


def test_html_equals_a_plain_version_and_the_windows_decide(monkeypatch):
    r = random.Random(6)
    pages = []
    for i in range(300):
        parts = [r.choice(["<p>{}</p>", "<p>{}", "<div><a href=x>{}</a></div>", "<li><a>x</a> {}", "<div class=ad>{}</div>", "<article>{}</article>", "<nav>{}</nav>", "<h2>{}</h2>"]).format(prose(r.choice([1, 2, 4, 30]), 100 * i + k)) for k in range(r.randrange(14))]
        pages.append("".join(parts))
    results = {}
    for window, surge in ((3, 80), (1, 1), (2, 300), (9, 5000)):
        monkeypatch.setattr(html_text, "WINDOW", window)
        monkeypatch.setattr(html_text, "SURGE", surge)
        results[window] = [html_text.main_text(p) for p in pages]
        assert results[window] == [plain_main_text(p, window, surge) for p in pages]
    assert all(sum(x != y for x, y in zip(results[3], results[w], strict=True)) > 30 for w in (1, 2, 9))


P = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>{P}</p><p>The <label>label word</label> stays.</p></article>", f"{P} The label word stays."),
        (f"<div><p>{P}</p><p><a href=x>One link alone</a></p><p>{P}</p></div>", f"{P} One link alone {P}"),
        (f"<div><p>{P}</p><ul><li><a href=x>a</a></ul><p>{P}</p></div>", f"{P} {P}"),
        (f"<article><p>{P}</p><p class='share-price-notice'>Shares fell.</p><p>{P}</p></article>", f"{P} Shares fell. {P}"),
        (f"<article><h1>T</h1><p>{P}</p><h3>3 Comments</h3><div><p>{P}</p></div></article>", f"T {P}"),
        (f"<article><h1>T</h1><p>{P}</p><h3>Comments</h3><p>{P}</p><h2>More</h2><p>x</p></article>", f"T {P} More x"),
        (f"<article><h1>Comments</h1><p>{P}</p></article>", f"Comments {P}"),
        (f"<p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><fieldset><p>{P} kept</p></fieldset>", f"{P} x=2 {P} kept"),
        (f"<article><p>{P}</p></article><div><p>Short note.</p></div>", P),
        (f"<article><p>{P}</p></article><div><p>{P} {P} {P}</p></div>", f"{P} {P} {P} {P}"),
    ],
)
def test_html_markup_weighs_and_does_not_cut(page, text):
    assert html_text.main_text(page) == text


class ArticleText(HTMLParser):
    """The text of a page's article by another parser, without what it and its classes mark as something else."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines = [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "p", "h1", "h2", "h3", "li", "ul", "div", "article", "aside", "nav", "footer", "section", "form"):
            self.lines.append([])
        if tag not in ("br", "meta", "img", "input", "link", "hr"):
            self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        self.lines.append([])
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        bad = any(t in ("nav", "aside", "footer", "script", "style", "form") for t in tags) or any(c in ("ad", "comments", "comment", "cookie") for _, c in self.open)
        if "article" in tags and not bad:
            self.lines[-1].append(data)


def test_html_of_the_tables_equals_another_parser():
    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (html,) in pages:
        parser = ArticleText()
        parser.feed(html)
        lines = [" ".join("".join(x).split()) for x in parser.lines]
        want = " ".join(x for x in lines if x)
        assert html_text.main_text(html).replace(" ", "") == want.replace(" ", "")


def test_html_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", "<p>" + "word " * 100_000)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["n_chars"], len(r["text"])) for r in out) == [(0, 0), (1, 1), (1, 1), (499_999, 499_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 3 token files


def test_a_second_attempt_leaves_the_first_ones_file(tmp_path):
    fs = pafs.LocalFileSystem()
    for text in ("first", "second"):
        (tmp_path / ".draft").write_text(text)
        token_files.publish(fs, f"{tmp_path}/.draft", f"{tmp_path}/0.tok")
    assert [p.name for p in tmp_path.iterdir()] == ["0.tok"] and (tmp_path / "0.tok").read_text() == "first"


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_and_unpack(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (token_files.unpack(raw, 1001, bits) == ids).all() and (token_files.unpack(raw, 5, bits, 990) == ids[990:995]).all()


def test_token_file_random_access():
    import io

    docs = [np.arange(n, dtype="<u4") * 3 % 50_000 for n in (0, 7, 300, 1, 64)]
    raw = token_files.to_file([5, None, 6, 7, 8], [d.tobytes() for d in docs], 16, block=64)
    f = token_files.TokenFile(io.BytesIO(raw))
    assert [f.doc_id(i) for i in range(f.n_docs)] == [5, None, 6, 7, 8]
    for i in (4, 2, 0, 3, 1):
        assert (f.document(i) == docs[i]).all()
    with pytest.raises(ValueError):
        token_files.to_file([1], [np.array([70_000], "<u4").tobytes()], 16)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_token_files_equal_the_library(odd, none, monkeypatch):
    out = token_files.digests(odd, PATH).collect()
    tok, want, start = tokenizer(), [], 0
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (-1 if r[0] is None else r[0]))
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out), key=lambda r: r[1])
    assert [g[0] for g in got] == [r[0] for r in rows]
    crc = lambda t: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert Counter((g[0], g[3]) for g in got) == Counter((i, crc(t)) for i, t in rows)
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert token_files.digests(none, PATH).count() == 0


# 4 nearest


def plain_nearest(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x)))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_on_unnormed_vectors_and_ties(spark):
    r = np.random.default_rng(0)
    x = (r.standard_normal((1200, 16)) * r.uniform(0.5, 2, (1200, 1))).astype(np.float32).astype(np.float64)
    x[100:160] = x[100]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [float("inf")] + [1.0] * 15), (2080, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    out = nearest.search(df, k=5)
    got = defaultdict(list)
    for q in out.orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
    want = plain_nearest(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert got[100] == want[100]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0]), (20, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.search(df).orderBy("query_id", "rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert nearest.search(df.limit(0)).count() == 0


SMALL = nearest.Sizes(substrings=24, postings=64, queries=16, block_bits=6, block_queries=16)


@pytest.mark.parametrize("sizes", [nearest.Sizes(), SMALL])
def test_all_codes_within_the_radius_are_met(spark, sizes, monkeypatch):
    """Through many cells, parts and blocks, what is met is just what is near in some substring."""
    x = np.random.default_rng(3).standard_normal((600, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    classes, asking, _, codes, met, _ = nearest._prepared(df, 5, sizes)
    c, rows = codes[6], classes.select("id", "v").toPandas()
    ids, held = rows["id"].to_numpy(), c.of_candidates(np.stack(rows["v"]).astype(float))
    got = defaultdict(set)
    for r in met.collect():
        new = [(r["block"] << sizes.block_bits) + int(p) for p in np.frombuffer(r["places"], "<u2")]
        assert got[r["qid"]].isdisjoint(new)
        got[r["qid"]].update(new)
    asked = asking.toPandas()
    assert sorted(ids) == list(range(600)) and len(asked) == 30
    for qid, v in zip(asked["id"], c.of_queries(np.stack(asked["v"]).astype(float)), strict=True):
        far = np.bitwise_count(held ^ v)
        assert got[qid] == set(ids[(far <= c.radius).any(axis=1)])
        assert got[qid] >= set(ids[far.sum(axis=1) <= sizes.substrings * (c.radius + 1) - 1])


def test_queries_that_meet_too_few_meet_all(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 8))
    x[20] = -x.sum(axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest.search(df, k=20, sizes=nearest.Sizes(substrings=1, radius=0, block_bits=5, block_queries=4))
    got = defaultdict(list)
    for q in out.orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
    want = plain_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20)
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}
    assert sum(got[q] == want[q] for q in want) >= 10


@pytest.mark.parametrize("spread", ["even", "clusters"])
def test_recall_and_share_met_over_several_blocks(spark, spread):
    r, n = np.random.default_rng(8), 20_000
    x = r.standard_normal((n, 32)) if spread == "even" else r.standard_normal((100, 32))[r.integers(0, 100, n)] + 0.3 * r.standard_normal((n, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    found = nearest.search(df).toPandas().groupby("query_id")["vec_id"].apply(set)
    assert len(found) == n // 20
    hits = 0
    for q in range(0, n, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * n / 100) >= 0.9
    share = nearest.met_counts(df).agg(F.avg("met")).first()[0] / n
    assert share < (0.5 if spread == "even" else 0.3)


# 5 near duplicates


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain_components(ids, texts):
    sets, up = plain_sets(texts), list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return Counter((x, len(sets[i]), least[find(i)]) for i, x in enumerate(ids))


def test_near_duplicates_equal_brute_force(spark):
    r, texts = random.Random(5), []
    for base in range(12):
        words = prose(r.choice([4, 5, 6, 30, 120, 121]), base).split()
        for _ in range(r.choice([1, 2, 9, 20])):
            now = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                now[r.randrange(len(now))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(now).title() if r.random() < 0.2 else " ".join(now))
    common = prose(60, 77)
    texts += [common + " " + prose(20, 1000 + i) for i in range(30)] + ["", None, " \n", "w x y z", "W X  y\tz", "w x y"]
    ids = r.sample(range(10_000), len(texts))
    out = near_duplicates.documents_with_components(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out.collect()) == plain_components(ids, texts)


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LIST", 7)
    monkeypatch.setattr(near_duplicates, "SHORT_LIST", 3)
    test_near_duplicates_equal_brute_force(spark)


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)] + [(-5, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_near_duplicates_on_odd_rows(spark, odd, none):
    out = near_duplicates.documents_with_components(odd).collect()
    assert len(out) == odd.count()
    assert {x["component_id"] for x in out if x["doc_id"] == 6} == {5}
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(x["doc_id"] for x in kept.collect())[7] == 1 and 6 not in {x["doc_id"] for x in kept.collect()}
    assert near_duplicates.documents_with_components(none).count() == 0 and near_duplicates.one_of_each(none).count() == 0


def test_one_row_of_each_component_whatever_its_ids(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (1, a + " more"), (2, a), (None, b), (None, b + " more"), (None, b), (7, c), (None, c + " more"), (8, None), (None, None)]
    out = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r["doc_id"], (r["text"] or "").removesuffix(" more")) for r in out]
    assert Counter(kept) == Counter([(1, a), (None, b), (7, c), (8, ""), (None, "")])


def test_shingles_of_a_text_beyond_a_slice(monkeypatch):
    text = prose(3000, 8)
    whole = shingles.shingle_sets([text, "a b", None])
    monkeypatch.setattr(shingles, "SLICE", 1000)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets([text, "a b", None]), strict=True))
    assert [len(s) for s in whole] == [len(s) for s in plain_sets([text, "a b", None])]


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(2)
    for n in (3, 100, 5000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: n // 2], r.integers(0, 2**63, 2 * n, dtype=np.uint64)])
        assert near_duplicates._differ(near_duplicates._parity(a), near_duplicates._parity(b)) <= len(np.setxor1d(a, b))


# 6 quality


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f g h " * 3, ("x y z\n" * 5) + prose(30, 1), prose(10, 1) + "\n\n" + prose(10, 1), "# $ a|b\n \n\n", "\u00a0 \x1c\x0b", prose(9, 4) + " " + prose(9, 4) + " q " + prose(9, 4)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in quality.rules(df).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_bad_hosts_take_their_documents_with_them(spark):
    good, bad = prose(40, 1), "short"
    rows = [(i, good if i % 50 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "poor") for i in range(200)] + [(5000, bad, "new"), (5001, good, None)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == (False, True) and got[1000] == (False, False) and got[1001] == (True, False) and got[5001] == (False, True)


def test_quality_on_odd_rows(odd, none):
    assert quality.rules(odd).count() == odd.count() and quality.kept(odd).columns == odd.columns
    assert quality.rules(none).count() == 0


# 7 byte-level BPE

TRICKY = ["", " ", "  ", "a  b", "a   b", "a \n b\n\n c \t", "\n", "hello<|endoftext|> world <|endoftext|>", "aaaaaaaa aaaa", "it's we'll 'S 're're", "日本語 🎉🎉 é", "\x1c \x1d a\x85 b", "  lead", "trail  ", "a" * 3000, "123 ½ ²³", "don't.  'tis", "\u3000 x\u2003y", "a, b.\nC!? d_ e."]


@pytest.mark.parametrize("coder", [bpe.coder, token_files.coder])
def test_pieces_equal_the_library(coder):
    r = random.Random(1)
    texts = TRICKY + ["".join(r.choice(" \n\ta'sèß1²<|>日 \u3000.,!-_") for _ in range(r.randint(1, 40))) for _ in range(1500)] + [LONG]
    tok = tokenizer()
    for text, ids in zip(texts, coder(PATH).encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]


def test_pieces_are_forgotten_and_texts_sliced(monkeypatch):
    from clauseworks.llm import chunks

    monkeypatch.setattr(chunks, "SLICE", 100)
    few = chunks.Pieces(bpe.load(PATH).encode_strings, max_kept=20)
    texts = [prose(90, i) for i in range(8)] + ["a   b " * 60]
    tok = tokenizer()
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in few.encode_all(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_rows(odd, none):
    tok = tokenizer()
    out = bpe.digests(odd, PATH).collect()
    want = Counter()
    for r in odd.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in out) == want
    assert bpe.digests(none, PATH).count() == 0


# 8 URL filter


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in url_filter.HOST_RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    label = [w for w in url_filter.BLOCKED_LABELS if w in host.split(".")]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if label else "allow")


def test_url_filter(spark):
    r = random.Random(2)
    urls = [None, "", "no-scheme/en/", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.net/de/8", "http://xexample.net/de/8", "http://free-bets.example.org/x", "a://b://com/en/", "http://com/en/", "http://COM", "http://x.org/es/", "http://net/de", "ftp://user@m.spam-farm.net:80/", "http://free-bets/", "http://\u212aom.com/en/"]
    urls += [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'm.free-bets.', 'adult-xy.'])}{r.choice(['example', 'other'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'EN'])}/{r.choice(['7', '78', '8', '1'])}{r.choice(['', '?q=1', '#a', '/x'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id long, url string")
    got = Counter((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge(df).collect())
    assert got == Counter((i, *plain_verdict(u)) for i, u in [*enumerate(urls), (0, None)])
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_rule_without_a_whole_token(spark):
    rules = (url_filter.Rule("any", "block", r"track", (), False),)
    df = spark.createDataFrame([(1, "http://xtracky.com/"), (2, "http://y.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules).collect()} == {1: "block", 2: "allow"}


# 9 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix(spark):
    r = random.Random(4)
    share = {"a": 30, "b": 900, "c": 200, None: 400, "e": 5, "f": 300}
    rows = [(i, prose(r.randint(0, 60), i), s) for i, s in enumerate(s for s, n in share.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, of, taken = plain_targets(sizes), {i: s for i, _, s in rows}, defaultdict(int)
    for x in out:
        assert x["target"] == pytest.approx(want[of[x["doc_id"]]]) and x["taken"] % max(1, x["size"]) == 0 and x["taken"] <= 3 * x["size"]
        assert x["source_size"] == sizes[of[x["doc_id"]]]
        taken[of[x["doc_id"]]] += x["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_mix_of_repeated_ids_in_any_order(spark):
    rows = [(i % 7, prose(i % 11 + 1, i // 2), "ab"[i % 2]) for i in range(90)]
    schema, want = "doc_id long, text string, source string", None
    for seed, parts in ((0, 1), (1, 5), (2, 9)):
        now = random.Random(seed).sample(rows, len(rows))
        out = mixing.mixed(spark.createDataFrame(now, schema).repartition(parts)).collect()
        want = want or Counter(map(tuple, out))
        assert Counter(map(tuple, out)) == want


def test_words_that_a_polynomial_takes_for_equal(spark):
    a, b = "", ""
    for i in range(2048):
        bit = i.bit_count() & 1
        a, b = a + "ab"[bit], b + "ba"[bit]
    assert not (shingles.shingle_sets([a])[0] == shingles.shingle_sets([b])[0]).all()
    many = [f"{'x' * (i % 300)}{i}" for i in range(3000)]
    assert len({int(shingles.shingle_sets([w])[0][0]) for w in many}) == 3000


def test_mix_on_odd_rows(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(x["taken"] == 0 for x in out if x["size"] == 0)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == sum(x["copies"] for x in out)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert {x["taken"] for x in mixing.mix(odd.where("doc_id in (0, 1)")).collect()} == {0}


# 10 licenses


def test_licenses():
    text = "Some prose here.\nLicensed under the Apache License, Version 2.0. All rights reserved.\nMore.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 1.1.\nlicensed driver"
    found = licenses.scanner().scan(text)
    assert [f.license for f in found] == ["Apache-2.0", "all-rights-reserved", "CC-BY-NC-4.0"]
    assert text[found[0].start : found[0].end] == "Licensed under the Apache License, Version 2.0" and not found[0].missing


@pytest.mark.parametrize("name, notice", licenses.TEMPLATES)
def test_every_notice_is_found_as_itself(name, notice):
    words = notice.split()
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    for text in (notice, f"{prose(40, 1)}\n{lines}\n{prose(40, 2)}"):
        assert name in [f.license for f in licenses.scanner().scan(text)], text


def test_one_word_more_is_told():
    [f] = licenses.scanner().scan("This work is licensed under the terms of the GNU General Public License, version 3.")
    assert f.license == "GPL-3.0" and f.extra == ("terms", "of", "the") or f.extra == ("the", "terms", "of")


def flat(notice):
    return " ".join(licenses.words_of(notice))


@pytest.mark.parametrize("before, after", [(20, 60), (400, 400)])
@pytest.mark.parametrize("name, notice", licenses.TEMPLATES)
def test_a_notice_in_a_line_without_sentence_ends(before, after, name, notice):
    text = f"by permission of the copyright owner {flat(prose(before, 1))} {flat(notice)} {flat(prose(after, 2))}"
    [f] = licenses.scanner().scan(text)
    assert f.license == name and text[f.start : f.end] == flat(notice) and not f.missing + f.extra


def test_every_notice_of_a_line_without_sentence_ends():
    text = " ".join(f"{flat(prose(150, i))} {flat(n)}" for i, (_, n) in enumerate(licenses.TEMPLATES))
    assert [f.license for f in licenses.scanner().scan(text)] == [n for n, _ in licenses.TEMPLATES]


@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_every_notice_of_a_long_run_of_lines(width):
    several = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words_of(t)) > 12] * 3
    text = "\n\n".join(textwrap.fill(t, width, break_long_words=False, break_on_hyphens=False) for _, t in several)
    found = licenses.scanner().scan(text)
    assert [f.license for f in found] == [n for n, _ in several]
    assert not any(f.missing + f.extra for f in found)


@pytest.mark.parametrize(
    "text, name",
    [("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the GNU GPL v3.", "GPL-3.0"), ("Released under the Apache License 2.0.", "Apache-2.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0")],
)
def test_short_notices(text, name):
    for whole in (text, f"{prose(60, 1)} {text} {prose(60, 2)}", f"{prose(400, 1)} copyright {prose(400, 2)} {text} {prose(400, 3)}"):
        assert [f.license for f in licenses.scanner().scan(whole)] == [name]


def plain_notices(text):
    """Every template at every place, the longest first, word for word."""
    have, out = licenses.words_of(text), {}
    taken = [False] * len(have)
    for name, notice in sorted(licenses.TEMPLATES, key=lambda t: -len(licenses.words_of(t[1]))):
        want = licenses.words_of(notice)
        for k in range(len(have) - len(want) + 1):
            if have[k : k + len(want)] == want and not any(taken[k : k + len(want)]):
                taken[k : k + len(want)] = [True] * len(want)
                out[k] = (name, k, k + len(want))
    return [out[k] for k in sorted(out)]


def test_generated_texts_equal_a_plain_scan():
    r, scan = random.Random(12), licenses.scanner().scan
    for i in range(400):
        parts = []
        for k in range(r.randrange(4)):
            parts += [prose(r.choice([5, 12, 40, 300]), 10 * i + k), r.choice(licenses.TEMPLATES)[1]]
        text = r.choice([" ", "\n", "\n\n"]).join([*parts, prose(r.choice([5, 30]), i)])
        if r.random() < 0.5:
            text = textwrap.fill(text, r.choice([40, 80]), break_long_words=False, break_on_hyphens=False)
        at = {m.start(): j for j, m in enumerate(licenses._WORD.finditer(text))}
        ends = {m.end(): j + 1 for j, m in enumerate(licenses._WORD.finditer(text))}
        assert [(f.license, at[f.start], ends[f.end]) for f in scan(text)] == plain_notices(text), text


def test_license_rows(odd, none):
    out = licenses.scan(odd).collect()
    assert len(out) == odd.count() and {r["n_found"] for r in out} == {0}
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize(
    "text, found",
    [
        ("MIT License", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-only\nimport os", ["GPL-2.0-only"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) WITH LLVM-exception and more words", ["Apache-2.0", "MIT"]),
        ("Use it under the terms of the GNU Affero General Public License v3.0 or later, as you like.", ["AGPL-3.0-or-later"]),
        ("This is not released under the MIT License.", []),
        ("It was never meant for sale. Released under the MIT License.", ["MIT"]),
        ("Copyright 2020\nApache License\nVersion 2.0, January 2004", ["Apache-2.0"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    ],
)
def test_licenses_by_tags_headings_and_denials(text, found):
    assert sorted(f.license for f in licenses.Scanner().scan(text)) == found


def test_notices_with_changed_words_are_found_with_their_differences():
    """Up to one word in sixteen is changed at random; a few such notices fall short where the wording repeats itself."""
    exact = 0
    r, scan = random.Random(12), licenses.Scanner()
    long = [(n, licenses.words_of(t)) for n, t in licenses.TEMPLATES if len(t.split()) >= 35]
    for k in range(200):
        name, words = r.choice(long)
        free = [i for i, w in enumerate(words[1:-1], 1) if not any(c.isdigit() for c in w) and not licenses._ANCHOR.search(w)]
        changed = set(r.sample(free, r.randrange(0, len(words) // 16 + 1)))
        text = " ".join(f"qq{k}x" if i in changed else w for i, w in enumerate(words))
        found = [f for f in scan.scan(f"{prose(40, k)}. {text}. {prose(40, k + 1)}") if f.license == name]
        assert len(found) <= 1
        exact += bool(found) and sorted(found[0].missing) == sorted(words[i] for i in changed)
    assert exact >= 195
