from __future__ import annotations

import html as entities
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import html as H
from casewright.llm import kdtree as K
from casewright.llm import queries
from tests.compare import spark_rows, sql_rows

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>The  title</h1><p><b>First &amp; bold<br>line &#x41;&nbsp;B<p>x.</p><aside>Side note of many words here</aside>
<p hidden>gone</p><p>a < b and <a href="x">a link</a> here</p></article>
<section id="comments"><p>A reader says many words about it all</p></section><form>Name<input></form>
<div class="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "The title\nFirst & bold line A B\nx.\na < b and a link here"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p", ""), ("<article><p>cut off &am", "cut off &am"), ("<article>one<p>two</p>three</article>", "one\ntwo\nthree"), ("<nav>a</nav>", "")])
def test_small_pages(page, text):
    assert H.main_text(page) == text


def test_unmarked_page_keeps_running_text():
    words = "word " * 40
    page = f"<div><a href=a>one</a> <a href=b>two</a></div><h2>A heading of six words is here</h2><p>{words}</p><p>{words}</p><div><a href=c>three</a></div>"
    assert H.main_text(page) == "\n".join(["A heading of six words is here", words.strip(), words.strip()])


def test_long_page_and_column(spark):
    long = "<article>" + "<p>some words</p>" * 20000 + "</article>"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, long), (1, PAGE)], "page_id long, html string")
    rows = df.select("page_id", H.extract_main_text(F.col("html")).alias("t")).collect()
    assert len(rows) == 4 and rows[1].t == "" and rows[2].t == "\n".join(["some words"] * 20000) and rows[0].t == rows[3].t


NAMED = f"""<article><h1>On search</h1><p class="tags">{"Running text about tags. " * 9}</p><div class="related-work">{"Others did the same. " * 9}</div>
<div id="search-algorithms"><p>{"A search goes on. " * 9}</p></div><ul class="tags"><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>
<div class="comment-list"><p>{"A reader says so. " * 9}</p></div></article><div class="related">{"More of this. " * 9}</div>"""


def test_article_text_may_bear_names_that_hint():
    kept = H.main_text(NAMED).split("\n")
    assert [t.split()[0] for t in kept] == ["On", "Running", "Others", "A"] and kept[3].startswith("A search")


def given(sf_dir: str) -> list[str]:
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"]).column(0).to_pylist()


def article_of(page: str) -> str:
    """What stands in the given pages' article, block for block."""
    article = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)\b[^>]*>", article)]
    return "\n".join(b for b in blocks if b)


def bare(page: str) -> str:
    """The page without its article tags and the advert's name."""
    return page.replace("<article>", "").replace("</article>", "").replace('<div class="ad">', "<div>")


def test_links_words_and_neighbours_decide_where_tags_say_little(monkeypatch):
    words = "word " * 40
    pages = [NAMED, f"<div><a href=a>one</a> <a href=b>two</a></div><p>{words}</p><p>{words}</p><div><a href=c>three</a></div>", f"<p>{words}</p><p>x y</p><div><a href=c>a b c</a></div>"]
    pages += [bare(p) for p in given("/root/testdata/sf0.01")]
    before = [H.main_text(p) for p in pages]
    features = H.block_features
    links, counts = ("link_density", "links_before", "links_after"), ("words", "words_before", "words_after", "words_next")
    for blanked, value in ((links, 0), (counts, 60), (H.NEIGHBOURS, 0)):
        at = [H.FEATURE_NAMES.index(n) for n in blanked]

        def blank(blocks, at=at, value=value):
            x = features(blocks)
            x[:, at] = value
            return x

        monkeypatch.setattr(H, "block_features", blank)
        changed = sum(H.main_text(p) != t for p, t in zip(pages, before))
        assert changed > len(pages) / 4, blanked
    used = set()

    def walk(node):
        if node.feature >= 0:
            used.add(H.FEATURE_NAMES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(H.block_tree())
    assert "words" in used and used & set(links) and len(used & set(H.NEIGHBOURS)) > 2


@pytest.mark.parametrize("frame", ['<div class="has-sidebar">|</div>', '<div id="page" class="layout sidebar-right">|</div>', '<div class="no-comments">|</div>', '<div class="subscription-content">|</div>', '<form id="aspnetForm">|</form>', '<div class="sidebar">|</div>', '<section class="comments"><div>|</div></section>'])
@pytest.mark.parametrize("tagged", [True, False])
def test_an_article_inside_a_marked_part_is_kept_whole(frame, tagged):
    before, after = frame.split("|")
    texts = ["A headline of seven words or so", "Running text of the article goes on. " * 8, "Short one.", "More of the running text follows here. " * 9, "The end of it comes with these words. " * 4]
    article = "".join(f"<p>{t}</p>" for t in texts)
    page = f"<body>{before}<nav><a href=a>Home</a></nav>{'<article>' if tagged else ''}{article}{'</article>' if tagged else ''}<footer>All rights</footer>{after}</body>"
    assert H.main_text(page) == "\n".join(t.strip() for t in texts)


def test_parts_of_names_only_hint_inside_an_article():
    text = "Running text of some length goes on here. " * 6
    page = f'<article><p class="menu-description">{text}</p><p class="ad-hoc-analysis">{text}</p><div class="ad">Buy this now</div><p>{text}</p></article>'
    assert H.main_text(page) == "\n".join([text.strip()] * 3)


def test_given_pages_without_their_article_tags():
    pages = given("/root/testdata/sf0.01")
    untagged = [p.replace("<article>", "").replace("</article>", "") for p in pages]
    assert [H.main_text(p) for p in untagged] == [article_of(p) for p in pages]
    wrapped = [p.replace("<body>", '<body><form class="sidebar">').replace("</body>", "</form></body>") for p in untagged]
    assert [H.main_text(p) for p in wrapped] == [article_of(p) for p in pages]
    assert sum(H.main_text(bare(p)) == article_of(p) for p in pages) > 0.98 * len(pages)


def test_tree_equals_a_plain_walk():
    table = H.labelled_blocks()
    x = np.concatenate([table[:, :-1], np.random.default_rng(1).permuted(table[:, :-1], axis=0)])

    def one(row, node):
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.share >= 0.5

    assert H.is_main(x).tolist() == [one(r, H.block_tree()) for r in x]
    assert (H.is_main(table[:, :-1]) == table[:, -1]).mean() > 0.97
    # the table disagrees with marks both ways
    marked, main = table[:, 0] >= 2, table[:, -1] > 0
    assert (marked & main).sum() > 20 and (~marked & ~main).sum() > 20


def test_unmatched_end_tags_take_linear_time():
    size = 150_000
    for page in ("<b>" * size + "</i>" * size, "<b><div>" + "<i>" * size + "</b>" * size, "<div>" * size + "</p>" * size):
        began = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - began < 10


def test_given_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op7_main_text(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == article_of(r.html) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_no_pages_and_clashing_names(spark):
    df = spark.createDataFrame([(1, PAGE, "x", 3)], "page_id long, html string, text string, n_chars int")
    assert df.select("*", H.extract_main_text(F.col("html")).alias("main")).first().main == H.main_text(PAGE)
    assert df.limit(0).select(H.extract_main_text(F.col("html"))).count() == 0


def slow(vectors, every, k):
    out = []
    for q, v in vectors:
        if q % every == 0:
            best = sorted((-(int(np.dot(v, w))), i) for i, w in vectors if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, np.round(rng.normal(0, 400, 5)).astype(int)) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in range(400, 600)]  # many equal vectors, many ties
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vectors], "vec_id long, v array<long>")
    for shard_rows in (None, 64):
        found = K.top_inner_products(df, F.col("vec_id") % 50 == 0, 7, shard_rows)
        assert sorted(tuple(r) for r in found.collect()) == slow(vectors, 50, 7)


def test_repeated_ids(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, [int(x) for x in rng.integers(-9, 9, 4)]) for i in range(60)]
    vectors += [vectors[0], vectors[0], (0, [5, 5, 5, 5]), vectors[7], vectors[7]]  # id 0 on four rows, two texts; 7 on three
    want = []
    for at, (q, v) in enumerate(vectors):
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, w)), i) for j, (i, w) in enumerate(vectors) if j != at)[:5]
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    for shard_rows in (None, 10):
        assert sorted(map(tuple, K.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, shard_rows).collect())) == sorted(want)


def test_clustered_vectors_leave_boxes_shut():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3000, (40, 6))
    data = np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 30, (8000, 6)))
    tree = K.Tree(np.arange(8000), np.arange(8000), data)
    opened = 0
    for q in data[:20]:
        bound = tree.bounds(q[None])[0]
        ids, scores = tree.search(-1, q, bound, 10, -np.inf)
        assert scores.tolist() == sorted((data @ q).tolist(), reverse=True)[:10]
        opened += sum(b - a for (a, b, left, _), x in zip(tree.nodes, bound) if left < 0 and x >= scores[-1])
    assert opened < 0.2 * 20 * 8000


def test_unusable_vectors_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (100, [0.5, -0.5], "x"), (1, None, "x"), (2, [nan, 1.0], "x"), (3, [inf, 1.0], "x"), (4, [1.0, None], "x"), (None, [1.0, 1.0], "x"), (5, [1.0], "x"), (6, [], "x"), (7, [-0.0001, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    found = sorted(tuple(r) for r in K.top_similar(df).collect())
    assert found == [(0, 1, 7, -1024), (0, 2, 100, 512 * 1024 - 512 * 2048), (100, 1, 7, -512), (100, 2, 0, 512 * 1024 - 512 * 2048)]
    assert K.top_similar(df.where("vec_id < 0")).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e8, 1.0]), (1, [3e4, 2.0]), (2, [3e4, 1.0])]
    found = K.top_similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, int(1e8 * 1024) * int(3e4 * 1024) + 1024 * 2048), (2, int(1e8 * 1024) * int(3e4 * 1024) + 1024 * 1024)]


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1.0])]
    found = K.top_similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_query_equals_sql(spark, sf_dir):
    names, rows = sql_rows(queries.ORACLE["op9_kdtree_topk"], sf_dir)
    df = queries.op9_kdtree_topk(spark, sf_dir)
    assert sorted(df.columns) == names and spark_rows(df) == rows
