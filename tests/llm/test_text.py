import hashlib
import html
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html_text, line_dedup, near_dedup
from tidemark.llm.graph import components
from tidemark.llm.queries import OP9_SQL

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    first: dict[str, int] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or first[key(x)] >= doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lines_of(df):
    kept = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    return sorted((tuple(r) for r in kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()), key=str)


def test_lines_equal_brute_force(spark):
    common = "A line that many hold"
    rows = [(i, f"own line number {i}\n{common}\nshort\n  A LINE THAT MANY HOLD\t\nother {i % 3} line here") for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n\n"), (5, "other text, same id\n" + common), (6, rows[6][1]), (None, common), (80, "é" * 9 + "\n" + "é" * 10), (79, "É" * 10 + "\n" + "é" * 10), (81, "w\n" * 3000 + common)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int").repartition(5)
    assert lines_of(df) == brute_lines(rows)
    assert lines_of(df.limit(0)) == []


def test_a_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "the very same line\n" * 3 + f"line of its own {i}") for i in range(400)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert lines_of(df) == brute_lines(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_equal_sql(spark, sf_dir, duck, same):
    from tidemark.llm.queries import op9_line_dedup

    same(duck.execute(OP9_SQL).df(), op9_line_dedup(spark, sf_dir).toPandas())


@given(st.sets(st.integers(0, 300)), st.integers(0, 310))
@settings(max_examples=60, deadline=None)
def test_bitmaps(gone, n):
    keep = line_dedup.unpack(line_dedup.pack(sorted(gone)), n)
    assert keep.tolist() == [i not in gone for i in range(n)]


# Near duplicates -------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * 100 >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows(seed, n_groups=12, size=14):
    random = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, doc = [], 0
    for _ in range(n_groups):
        base = random.choice(vocabulary, random.integers(5, 400)).tolist()
        for _ in range(size):
            own = list(base)
            for _ in range(random.integers(0, 1 + len(base) // 30 + 2)):
                own[random.integers(len(own))] = random.choice(vocabulary)
            rows.append((doc * 7 % 1009, " ".join(own)))
            doc += 1
    return rows


@pytest.mark.parametrize("k,percent,rows_a_band", [(3, 85, 8), (5, 80, 6)])
def test_near_equals_brute_force(spark, k, percent, rows_a_band):
    rows = near_rows(k)
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "two words"), (2006, "É a b"), (2007, "é a b"), (2008, "x y z " * 30_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n string").repartition(4)
    found = near_dedup.near_duplicates(df, near_dedup.NearSpec(words=k, percent=percent, rows=rows_a_band))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()} == brute_near(rows, k, percent)


def test_near_repeats_and_nothing(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "other words here"), (3, text)], "doc_id long, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3]
    assert {r["component_id"] for r in out if r["doc_id"] < 3} == {1}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_exact_pass_finds_what_a_star_misses(spark):
    """Of three, the centre is like neither of two that are like each other."""
    spec = near_dedup.NearSpec(percent=80)
    sets = [(1, list(range(0, 100))), (2, list(range(25, 125))), (3, list(range(28, 128)))]
    df = spark.createDataFrame([(i, len(s), s) for i, s in sets], "id long, n long, shingles array<long>")
    clusters = df.select("id", "n", F.lit(1).cast("long").alias("cluster"), F.col("id").alias("comp"))
    assert [tuple(sorted(r)) for r in near_dedup.missed_links(clusters, df, spec).collect()] == [(2, 3)]


def test_signature_is_fair():
    """Bins agree as often as the sets do."""
    random = np.random.default_rng(8)
    spec = near_dedup.NearSpec()
    for size in (20, 400):
        agree = []
        for _ in range(60):
            whole = np.unique(random.integers(0, 1 << 63, size * 2, dtype=np.uint64) * np.uint64(2))
            random_ids = near_dedup.mix(whole)
            a, b = np.sort(random_ids[: int(len(whole) * 0.9)]), np.sort(random_ids[int(len(whole) * 0.1) :])
            agree.append((near_dedup.signature(a, spec) == near_dedup.signature(b, spec)).mean())
        assert abs(np.mean(agree) - 0.8) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    out = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


# Pages -----------------------------------------------------------------------------------

WEIGHTS = html_text.RegionWeights(1.0, -2.0, {"p": -0.1, "li": -2.0, "a": -2.0})


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<html><body><nav><ul><li><a>menu</a></li></ul></nav><article><h1>T  i\n tle</h1><p><b>One<br><p>Two &lt;x&gt;</p></article><footer>f</footer>", "T i tle\nOne\nTwo <x>"),
        ('<article><p>a b c</p><div class="comments"><p>me too</p></div><aside>x</aside><form><p>mail</p></form><p>d e</p></article>', "a b c\nd e"),
        ('<div class="sidebar">s s s s</div><div><p>the words of it</p><p>and more</p></div><ul><li><a>x</a></li><li><a>y</a></li></ul>', "the words of it\nand more"),
        ("<nav>never closed<article><p>text</p></article>", "text"),
        ('<script>var t="</p><article>";</script><style>p{}</style><!-- <p>no</p> --><main><p title="a>b">yes</p></main>', "yes"),
        ("<article><p>first one</p></article><div>x</div><article><p>this is the longer one</p></article>", "this is the longer one"),
        ("<article><h2>Downloads</h2><p class='address-line'>ok</p><div id=readership>fine</div></article>", "Downloads\nok\nfine"),
    ],
)
def test_pages(page, want):
    assert html_text.extract(page, WEIGHTS) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p class="share">Share<p>Body one</p><p>Body two</p></article>', "Body one\nBody two"),
        ('<article><p class="share">Share<hr>Body <b>one</b><div>Body two</div></article>', "Body one\nBody two"),
        ('<article><div><p class="share">Share <b>x</i></div>Body</article>', "Body"),
        ('<article><ul><li>one<li class="share">Share<ul><li>x<li>y</ul>z<li>two</ul><p>Body</article>', "one\ntwo\nBody"),
        ('<article><ul><li class="share">Share</ul><dl><dt>a<dd class="share">b<dt>c<dd>d</dl></article>', "a\nc\nd"),
        ('<article><table><tr><td class="share">s<table><tr><td>x</table>y<td>a<tr class="share"><td>s<tr><td>b</table>c</article>', "a\nb\nc"),
        ('<article><div class="share"><p>s<p>t</div><p>Body<section><span class="share">s</section>on</article>', "Body\non"),
    ],
)
def test_pages_with_end_tags_left_out(page, want):
    assert html_text.extract(page, WEIGHTS) == want


LONG = "{hidden : class=ads > < " + "x y " * 25_000 + " hidden }"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><div class='sidebar' data-x='{'x > ' * 25_000}'>side<div data-y=\"{'y>' * 50_000}\">s</div>side</div><p>body</p></article>", "body"),
        (f"<p>a b c d</p><ul><li>x</ul><article data-x=\"{'z ' * 50_000}\"><p>body one</p><p data-x='{'> ' * 1_500}'>body two three</p></article>", "body one\nbody two three"),
        (f"<article><p data-x='{LONG}'>body</p><p srcset=a/b?c='d title=don't>more</p></article>", "body\nmore"),
        ("<article><p title=\"never closed>body</p><p>more</p></article>", "body\nmore"),
    ],
)
def test_pages_with_long_attributes(page, want):
    assert html_text.extract(page, WEIGHTS) == want


def test_odd_tags_take_linear_time():
    for page in ("<a title='" * 100_000, "<a " * 100_000, "<a x=\">" * 100_000, "<a x='>\"" * 100_000, "<p class=\"" + "x " * 500_000):
        html_text.parse(page)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<main><article><p>the words of it</p></article><div><a>unmarked</a><a>related</a></div></main>", "the words of it"),
        ("<main><p>the many words of it</p><article>card</article></main>", "the many words of it\ncard"),
    ],
)
def test_the_innermost_element_with_the_run(page, want):
    assert html_text.extract(page, WEIGHTS) == want


def test_deep_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "x", "<p><button>" + "<div>" * 100_000 + "x", '<p class="share">' * 100_000 + "x", "<ul><li>" * 100_000 + "</ul>" * 100_000):
        html_text.parse(page)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><section id="search-algorithms"><p>Binary search halves.</p></section><p class="shared-memory">Memory</p><p class=address-line>ok</p></article>', "Binary search halves.\nMemory\nok"),
        ('<article><p>Body</p><div class="cookie-banner">We use</div><div id="siteFooter2">f</div><ul class="share_buttons top"><li>Tweet</ul><section class="comments"><p>me too</section><p>End</article>', "Body\nEnd"),
        ("<article><p>a <button>b</button> c <svg>d</svg>e<select><option>f</select></p></article>", "a c e"),
        ("<article><ul>" + "<li>x</li>" * 40 + "</ul><table>" + "<tr><td>y</td></tr>" * 40 + "</table></article>", "\n".join(["x"] * 40 + ["y"] * 40)),
        ("<p>stray words before it, and more of them than it has</p><article><p>the text</p></article><p>stray</p>", "the text"),
        ("<article></article><div><p>the words stand here</p></div>", "the words stand here"),
    ],
)
def test_scores_set_the_region(page, want):
    assert html_text.extract(page, WEIGHTS) == want


def test_the_scan_sets_the_ends(monkeypatch):
    pages = [
        "<p>stray words before</p><article><p>the text of it</p></article><p>stray</p>",
        "<ul><li><a>menu</a><li><a>of</a><li><a>links</a></ul><div><p>the words of it are many</p></div><ul><li><a>x</a><li><a>y</a></ul>",
    ]
    want = [html_text.extract(p, WEIGHTS) for p in pages]
    assert want == ["the text of it", "the words of it are many"]
    monkeypatch.setattr(html_text, "best_run", lambda values: (0, len(values)))
    monkeypatch.setattr(html_text, "scores", lambda tokens, weights: [max(0.0, t.words) for t in tokens])
    assert all(html_text.extract(p, WEIGHTS) != w for p, w in zip(pages, want))


def test_marks_are_learned():
    """A name no list holds: its words stand beside the content of labelled pages, so it goes elsewhere too."""
    counts = {("word", ""): (9_000, 1_000), ("tag", "p"): (300, 5), ("mark", "zork"): (0, 900), ("mark", "wide"): (8_000, 900), ("mark", "share"): (500, 0)}
    weights = html_text.weights_from(counts)
    assert weights.marks["zork"] < -2 and weights.marks["wide"] > -0.1 and weights.marks["share"] == -4
    page = '<div class="wide"><p>the words of it</p><div class="zork">gone</div></div>'
    assert html_text.extract(page, weights) == "the words of it"
    assert html_text.extract(page, html_text.RegionWeights(other=-0.1)) == "the words of it\ngone"
    marks: list = []
    tokens = html_text.parse('<div class="zork Wide2">a<p id=x>b<i class=zork>e</i></div><p>c<article>d</article>', None, marks)
    assert [t.text for t in tokens if t.words > 0] == ["a", "b", "e", "c", "d"]
    assert marks == [("x", [2, 0, 0]), ("zork", [3, 0, 0]), ("wide#", [3, 0, 0])]  # a mark within itself counts once


def test_best_run_equals_brute_force():
    random = np.random.default_rng(9)
    for _ in range(50):
        value = random.normal(size=25).round(1).tolist()
        a, b = html_text.best_run(value)
        assert sum(value[a:b]) == pytest.approx(max(0, *(sum(value[i:j]) for i in range(25) for j in range(i + 1, 26))))
    assert html_text.best_run([-1.0, -2.0]) == html_text.best_run([]) == (0, 0)


def test_pages_as_a_frame(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = html_text.learn(pages)
    assert weights.word > 0 and all(v < 0 for v in weights.tags.values()) and weights.tags["nav"] < weights.tags["p"] and "div" not in weights.tags
    out = html_text.main_text(pages, weights).collect()
    assert len(out) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in out)
    assert weights.marks["ad"] < -4
    words = lambda x: re.sub(r"<[^>]*>", " ", x)
    for r, own in zip(sorted(out, key=lambda r: r["page_id"]), pages.orderBy("page_id").collect()):
        article = own["html"].split("<article>")[1].split("</article>")[0]
        assert r["text"].split() == html.unescape(words(article)).split()
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>" * 20_000 + "x"), (3, "u", "<a title='" * 500)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.main_text(odd, weights).collect())[:2] == ["", ""]
    assert html_text.main_text(pages.limit(0), html_text.learn(pages.limit(0))).count() == 0


PARAGRAPH = "<p>" + "word " * 60 + "</p>"
FURNITURE = "reader-comments user-comments article-comments post-comments comment-thread discussion responses related-articles related-stories share-tools global-nav gdpr-consent popup-overlay recommended"


@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>"])
def test_furniture_by_its_parts(around):
    page = lambda name: around % f"{PARAGRAPH}<div class='{name}'><p>some more here.</p></div>{PARAGRAPH}"
    for name in FURNITURE.split():
        assert "some more" not in html_text.extract(page(name), html_text.RegionWeights()), name
    for name in ("search-algorithms", "shared-memory", "readership", "content-body"):
        assert "some more" in html_text.extract(page(name), html_text.RegionWeights()), name


def test_parts_are_learned_from_what_stands_beside():
    counts = {("word", ""): (10_000, 5_000), ("mark", "zq-strip"): (0, 900), ("part", "zq"): (0, 900), ("part", "strip"): (0, 900), ("linked", ""): (10, 400)}
    weights = html_text.weights_from(counts)
    page = f"<article>{PARAGRAPH}<div class='%s'>some more here.</div>{PARAGRAPH}</article>"
    assert "some more" not in html_text.extract(page % "strip-zq", weights)  # a mark never seen, of parts that were
    assert "some more" in html_text.extract(page % "zq-algebra", weights)  # a part that nothing speaks against
    assert weights.linked < -1


def test_lists_of_links_are_no_text():
    links = "".join(f"<li><a href=/{i}>linked title {i}</a></li>" for i in range(4))
    text = html_text.extract(f"<article>{PARAGRAPH}<ul>{links}</ul><p><a href=/>one link alone</a></p>{PARAGRAPH}</article>", html_text.RegionWeights())
    assert "linked title" not in text
    text = html_text.extract(f"<article>{PARAGRAPH}<p><a href=/>one link alone</a></p><ul><li><a href=/>a</a> and more</li></ul></article>", html_text.RegionWeights())
    assert "one link alone" in text and "a and more" in text


@pytest.mark.parametrize("page", ["<!" * 500_000, "</ " * 330_000, "<?x" * 330_000, "<div class=x>" * 100_000 + "word", "<div class=x><p>w" * 50_000], ids=["declarations", "ends", "questions", "marked", "paragraphs"])
def test_unclosed_and_nested_marks_take_linear_time(page):
    began = time.process_time()
    html_text.parse(page, None, [])
    whole = time.process_time() - began
    began = time.process_time()
    html_text.parse(page[: len(page) // 4], None, [])
    quarter = time.process_time() - began
    assert whole < max(1.0, 8 * quarter)
