"""Main bodies of pages, and top N of groups."""

import random

import pytest

from forumlake.llm.main_body import Scanner, best_region, body_lines, learn_weights, main_body
from forumlake.llm.page_labels import HAND, OTHER, OUTSIDE, SIGN, TEXT, hand_labelled, labels_of, read_page, signature_classes
from forumlake.llm.page_lines import Reader, visible_lines
from forumlake.llm.queries import ORACLES, QUERIES
from forumlake.llm.topn import top_n


def test_best_region_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        x = [rnd.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rnd.randint(0, 12))]
        a, b = best_region(x)
        best = max((sum(x[i : j + 1]) for i in range(len(x)) for j in range(i, len(x))), default=0)
        assert (a, b) == (0, -1) if best <= 0 else sum(x[a : b + 1]) == pytest.approx(best)


def test_read_page_lines():
    p = read_page("<HTML><head><title>A | Site</title>\n<script>\nx\n</script></head>\n<BODY><div class='k'>one <a href=/u>two</a>\r\n<!-- no\nno --><p hidden>secret</p>three &amp; <br>\n</div>end")
    assert [x.text for x in p.lines] == ["", "", "", "", "one two", "", "three &", "end"]
    assert p.title == "A | Site" and p.lines[4].linked == 3 and p.elements[p.lines[4].at].cls == "k"
    for odd in ("", "<", "<a", "</div></div>", "<!--", "<script>", "<div" * 50, "<div>" * 2000, "a < b > c", "\n\n"):
        assert len(read_page(odd).lines) == odd.count("\n") + 1


SEMANTIC = """<html><head><title>Heading | S</title></head>
<body>
<nav><a href="/1">Home</a> <a href="/2">Groups</a></nav>
<main>
<h1>Heading</h1>
<article>
<div><a href="/u">Ann</a> 2024-1-6 15:22</div>
<p>I think that the first half was slow, but the ending is
good and worth it.</p>
<ul><li>Winter Harbor</li></ul>
<div class="sign">I read all of it.</div>
<a href="/r">Reply</a>
</article>
<div>Sponsored: reprints this week #5</div>
<article>
<div><a href="/u">Bob</a> 2024-1-7 15:22</div>
<p>+1</p>
</article>
<div style="display:none">hidden text of the page</div>
</main>
<aside><h3>Related topics</h3>
<p>I think that the second half… <a href="/3">Read more</a></p></aside>
<footer><p>All texts belong to their writers.</p></footer>
</body></html>"""
BODY = [5, 8, 9, 10, 17]
PLAIN = """Home | Groups | Blogs
Groups > Lounge > Heading
Heading
Ann posted by 2024-1-6 15:22
I think that the first half was slow, but the ending is good and worth it.
> quoted text of another
-- my signature
[Reply]
Bob posted by 2024-1-7 15:22
I think so too.
Page 1 of 2 · Next · Last
Related topics | More
© 2024 The archive. All texts belong to their writers."""


@pytest.fixture(scope="module")
def weights(spark):
    pages = spark.createDataFrame([(i, "Heading", SEMANTIC) for i in range(20)], "page_id bigint, title string, contentHtml string")
    return learn_weights(pages)


def test_visible_lines_keep_their_numbers():
    page = "<html><head><title>A &amp; B | S</title>\n<script>\nx\n</script></head>\n<body><div\n class=k>one</div><!-- no\nno -->\n<p style='display:none'>gone\n<b>gone</b></p>\n<p hidden>gone\nend"
    lines, title = visible_lines(page)
    assert title == "A & B | S" and len(lines) == page.count("\n") + 1
    shown = [f.text for f in Reader().read(page, None).facts]
    assert [(i, t) for i, t in enumerate(shown) if t] == [(5, "one")]
    for odd in ("", "<", "<a", "</div></div>", "<!--", "<script>", "<div" * 50, "<div>" * 2000, "a < b > c", "\n\n", "<title>", "<head>\nx", "<p hidden>", "© 5", "-- ", "[", "٣"):
        assert len(Reader().read(odd, "t").facts) == odd.count("\n") + 1


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    t = time.time()
    for odd in ("<div>\n" * 60_000 + "</td>\n" * 60_000, "<p hidden>\n" * 40_000, "<div class=x>" * 60_000 + "</section>" * 60_000, '<div style="display:none">' * 20_000 + "</div>" * 20_000 + "x"):
        assert len(Reader().read(odd, "t").facts) == odd.count("\n") + 1
    assert time.time() - t < 60
    nested = "<div hidden>a\n<div>b</div>\nc</div>d\n<p hidden>e\n<p hidden>f</p>g"
    assert [f.text for f in Reader().read(nested, "t").facts] == ["", "", "d", "", "g"]


def test_labels_and_weights(weights):
    y = labels_of([SEMANTIC, PLAIN])
    assert y[1] is None and [i + 1 for i, k in enumerate(y[0]) if k == TEXT] == BODY
    assert y[0][10] == SIGN and y[0][6] == OTHER and y[0][2] == y[0][-1] == OUTSIDE
    assert all(len(c.split("\n")) == len(k) and set(k) <= {OUTSIDE, TEXT, OTHER} for _, c, k in hand_labelled()) and len(hand_labelled()) == len(HAND)
    inside = {t: max(w[1:]) - w[0] for t, w in weights.items()}
    assert inside["w:think"] > 0 > inside["t:nav"] and inside["f:title"] > 0 > inside["w:cookies"]


def test_hand_labelled_pages_are_learned(weights):
    for title, content, y in hand_labelled():
        facts = Reader().read(content, title).facts
        assert body_lines(content, title, weights) == [i + 1 for i, k in enumerate(y) if k == TEXT and facts[i].text]


ARTICLE = """<html><head><title>Three lakes in a day | Walks</title></head>
<body><nav><a href="/">Home</a> <a href="/w">Walks</a></nav>
<main>
<h1>Three lakes in a day</h1>
<p>By Ann, 6 January 2024</p>
<p>We left before sunrise and had the first lake to ourselves.</p>
<p>The second one is larger, and the path around it was closed when we came.</p>
</main>
<aside><h3>Related topics</h3>
<p>A longer walk that ends… <a href="/3">Read more</a></p></aside>
<footer><p>© 2024 Walks. All rights reserved.</p></footer>
</body></html>"""


def test_article_without_dated_posts_keeps_its_paragraphs(weights):
    for title in ("Three lakes in a day", None):
        got = body_lines(ARTICLE, title, weights)
        assert {4, 6, 7} <= set(got) <= {4, 5, 6, 7}


def test_the_region_decides(spark, sf):
    """The same lines, with the region taken to be the whole page, are others on most pages."""
    pages = spark.read.parquet(f"{sf}/topic.parquet").where("contentHtml <> ''").dropDuplicates(["contentHtml"])
    scanner = Scanner(learn_weights(pages))
    differ = n = 0
    for r in pages.collect():
        got = scanner.body_lines(r.contentHtml, r.title)
        if got:
            page = scanner.reader.read(r.contentHtml, r.title)
            start, end, sums = scanner.region(page)
            assert start < got[0] <= got[-1] <= end + 1
            whole = [i + 1 for i, f in enumerate(page.facts) if f.text and sums[i, 1] > sums[i, 2]]
            n, differ = n + 1, differ + (whole != got)
    assert n >= 10 and differ > 0.8 * n


def test_weights_do_not_depend_on_partitions(spark):
    rows = [(i, f"Heading {i % 3}", SEMANTIC.replace("Heading", f"Heading {i % 3}")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, title string, contentHtml string")
    assert learn_weights(df.repartition(1), sample=7) == learn_weights(df.repartition(9), sample=7)


def test_body_of_pages(weights):
    assert body_lines(SEMANTIC, "Heading", weights) == BODY
    assert body_lines(SEMANTIC.replace("\n", "\r\n"), " Heading ", weights) == BODY
    assert body_lines(SEMANTIC, None, weights) == BODY
    assert body_lines(PLAIN, "Heading", weights) == [3, 5, 6, 10]
    for none in (None, "", " \n ", "<nav><a href=/1>Home</a></nav>\n<p>This topic has been removed.</p>"):
        assert body_lines(none, "Heading", weights) == []
    long = SEMANTIC.replace("<p>+1</p>", "<p>" + "a long text of a post, that is. " * 20_000 + "</p>")
    assert body_lines(long, "Heading", weights) == BODY


def test_signature_classes():
    from collections import Counter

    uses = Counter({("p", "all"): 5, ("p", "after"): 2, ("p", "before"): 4, ("s", "all"): 3, ("s", "after"): 3, ("q", "all"): 2, ("q", "before"): 1, ("only", "all"): 4})
    assert signature_classes(uses) == {"p": False, "s": True, "q": False, "only": False}


def test_main_body_cases(spark):
    rows = [(1, "Heading", SEMANTIC, 1), (1, "Heading", SEMANTIC, 1), (2, "Heading", None, 1), (3, None, "", 1), (4, "Heading", PLAIN, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, title string, contentHtml string, line_no int")
    got = sorted(map(tuple, main_body(df).collect()))
    assert [n for p, n in got if p == 1] == BODY and {p for p, _ in got} == {1, 4}
    assert main_body(df.where("false")).count() == 0


# -- top N -------------------------------------------------------------------

ITEMS = "g1 bigint, g2 bigint, score bigint, item bigint, tie1 bigint, tie2 bigint"


def brute(rows, n):
    groups = {}
    for r in set(rows):
        if None not in r:
            groups.setdefault(r[:2], []).append(r)
    return sorted((*r, i + 1) for g in groups.values() for i, r in enumerate(sorted(g, key=lambda r: (-r[2], -r[3], r[4], r[5]))[:n]))


@pytest.mark.parametrize(("n", "parts"), [(1, 3), (5, 1), (5, 16), (200, 7)])
def test_top_n_equals_brute_force(spark, n, parts):
    rnd = random.Random(n * 31 + parts)
    rows = [(0, rnd.choice([1, 1, 1, 1, 2, 3, rnd.randint(4, 60)]), rnd.randint(0, 30), rnd.randint(-9, 9), rnd.randint(0, 2), 0) for _ in range(6_000)]
    rows += rows[:500] + [(0, None, 1, 1, 1, 1), (0, 1, None, 1, 1, 1), (None, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, ITEMS + "").repartition(5)
    assert sorted(map(tuple, top_n(spark, df, n, parts).collect())) == brute(rows, n)


def test_top_n_cases(spark):
    df = spark.createDataFrame([(1, 1, 5, 5, 0, 0), (1, 1, 5, 5, 0, 0), (1, 1, 5, 6, 0, 0)], ITEMS)
    assert [r.item for r in top_n(spark, df, 1).collect()] == [6] and top_n(spark, df, 0).count() == 0 and top_n(spark, df, 9).count() == 2
    assert top_n(spark, df.where("false"), 3).count() == 0
    one = spark.range(5_000).selectExpr("1L as g1", "1L as g2", "id as score", "id as item", "0L as tie1", "0L as tie2", "'x' as pos")
    assert sorted(r.score for r in top_n(spark, one, 1_500, 9).collect()) == list(range(3_500, 5_000))


def test_queries_of_the_subpackage(spark, sf):
    from tests.oracle import assert_same, connect

    con = connect(sf)
    for name, f in QUERIES.items():
        if name in ORACLES:
            assert assert_same(spark, con, sf, f, ORACLES[name]) > 0 or name == "p8_violations"
        else:
            assert f(spark, sf).count() > 0


def test_undated_post_inside_the_region(weights):
    undated = SEMANTIC.replace("<div>Sponsored: reprints this week #5</div>", "<article><p>I think that the ending is good and worth it.</p></article>")
    assert body_lines(undated, "Heading", weights) == [5, 8, 9, 10, 14, 17]
