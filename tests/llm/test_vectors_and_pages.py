"""Searches against brute force, page texts against planted articles."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    v = real.where("vec_id = 7").first()["embedding"]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 64), (1060, [None] + [1.0] * 63), (1080, [float("nan")] * 64), (1100, [float("inf")] * 64), (None, v), (1120, v), (1121, v), (1121, v), (1140, [1.0, 2.0]), (1160, [2.0, 1.0])]
    odd += [(2000 + k, v) for k in range(60)]  # a common vector
    return real.unionByName(spark.createDataFrame(odd, real.schema)).withColumn("score", F.lit(1)).cache()


def _brute(vectors, every, k, turn, zero):
    rows = [(r["vec_id"], turn(np.array(r["embedding"], float))) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    rows = [(i, v) for i, v in rows if zero or v.any()]
    out = {}
    for q, v in {i: v for i, v in rows if i % every == 0}.items():
        out[q] = sorted((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_exact_search(vectors, shard_rows):
    from gatewright.llm.covertree import top_k

    expected = _brute(vectors, 20, 10, lambda v: np.floor(1024 * v), True)
    got = top_k(vectors, lambda i: i % 20 == 0, shard_rows=shard_rows, block_rows=20).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert found == {q: [(int(s), i) for s, i in v] for q, v in expected.items() if v}
    assert top_k(vectors.where("false"), lambda i: i % 20 == 0).count() == 0


def test_dual_tree_prunes_only_what_cannot_win():
    from gatewright.llm.covertree import dual_search

    draw = np.random.default_rng(4)
    x = np.floor(np.concatenate([draw.normal(0, 40, (400, 6)), draw.normal(900, 3, (300, 6)), np.tile(draw.normal(0, 50, (1, 6)), (200, 1))]))
    ids, is_query = draw.permutation(len(x)).astype(np.int64), draw.random(len(x)) < 0.2
    for q, (near, score) in dual_search(x, ids, is_query, ~is_query, 5).items():
        all_ = sorted((-int(x[q] @ x[j]), int(ids[j])) for j in np.flatnonzero(~is_query) if ids[j] != ids[q])[:5]
        assert [(-s, i) for i, s in zip(near.tolist(), score.tolist())] == all_


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_graph_search(vectors, shard_rows):
    from gatewright.llm.hnsw import nearest

    expected = _brute(vectors, 20, 20, lambda v: v, False)
    found = {}
    for r in sorted(nearest(vectors, lambda i: i % 20 == 0, shard_rows=shard_rows, block_rows=30).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {q for q, v in expected.items() if v}
    hits = sum(len({i for i, _ in found[q]} & {i for _, i in v}) for q, v in expected.items() if v)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, v in found.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True) and len(v) == len(expected[q])
        assert v[0][1] == pytest.approx(-expected[q][0][0])
    assert nearest(vectors.where("false"), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("ratio", [1, 1_000, 10_000])
def test_graph_search_beside_a_long_vector(spark, ratio):
    from gatewright.llm.hnsw import nearest

    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (60, 32))[draw.integers(0, 60, 3000)] + draw.normal(0, 0.3, (3000, 32))
    x[1] *= ratio
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(rows, lambda i: i % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    print("recall", ratio, hits / 3000)
    assert hits >= 0.9 * 3000


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>";</script><style>p{}</style></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Title %(n)d</h1><!-- no --><p>One &amp; two<br>three <b>bo</b>ld &eacute;&#233;<p>Next%(n)d<ul><li>a%(n)d<li>b</ul><div class="ad">Buy</div>
<div class="promoted-box"><p>Same on all</p></div><form><input><button>Go</button></form><section id="comments"><p>Nice!</p></section></article><footer>&copy; x</footer>"""
PLAIN = "<body><div class='top'>Acme <i>site</i></div><div>Words of page %(n)d.</div><table><tr><td>x%(n)d<td>y%(n)d</table><div class='end'>All rights</div>"


def test_pages(spark):
    from gatewright.llm.html_text import main_text

    rows = [(k, f"http://a.example/{k}", PAGE % {"n": k}) for k in range(8)] + [(100 + k, f"https://u@B.example:80/{k}", PLAIN % {"n": k}) for k in range(8)]
    rows += [(200, None, None), (201, "junk", ""), (202, "http://c/", "no markup &lt;here"), (203, "http://c/", "<p>a<<b>b</q <div"), (204, "http://c/", "<div>" * 3000 + "deep"), (0, "http://a.example/0", PAGE % {"n": 0})]
    rows += [(300 + k, "http://copy.example/", "<p>The same page.</p>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"]) for r in main_text(pages).collect())
    expected = [(k, f"Title {k} One & two three bold éé Next{k} a{k} b") for k in (0, 0, 1, 2, 3, 4, 5, 6, 7)]
    expected += [(100 + k, f"Words of page {k}. x{k} y{k}") for k in range(8)]
    assert got[:17] == expected
    rest = dict(got[17:])
    assert rest[200] == rest[201] == "" and rest[202] == "no markup <here" and rest[204] == "deep"
    assert all(rest[300 + k] == "The same page." for k in range(9))  # copies of a page are no template
    assert main_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<body><div class='content sidebar-right'><article><h1>Title</h1><p>The whole story</article></div><div class=sidebar>Links</div>", "Title The whole story"),
    ("<div id='page' class='header-fixed'><main><p>The whole story</p><div class=share>Share</div></main></div>", "The whole story"),
    ("<div id=page class='header-fixed'><div role=main class='widget-main'>The whole story</div></div><div>Other</div>", "The whole story"),
    ("<article class='post comments-open'><p>The whole story<div class=social>Like</div><section id=comments><article class=comment>Nice</article></section></article>", "The whole story"),
    ("<div class='wrap no-banner sidebar-right'><p>The whole story of an unmarked page</p></div><div class=sidebar>Links</div>", "The whole story of an unmarked page"),
    ("<article><p>First part</article><div>Between</div><article class='post comments-open'><p>Second and longer part</article><div class=related><article>Tease</article></div>", "First part Second and longer part"),
])
def test_wrappers_and_articles_are_no_noise(html, text):
    from gatewright.llm.html_text import main_element, parse, text_of

    assert text_of(main_element(parse(html))[0]) == text


def test_recurring_blocks(spark):
    from gatewright.llm.html_text import main_text

    notice = "<p>This site is supported by readers; please write to the editor with your notes."
    rows = [(k, f"http://marked/{k}", f"<article><h1>Title {k}</h1>{notice}<p>Story {k}<h2>References</h2><p>Source {k}</article>") for k in range(12)]
    plain = "<body><p>Acme news<h1>Title %(n)d</h1><p>Story %(n)d<h2>References</h2><ul><li>Source %(n)d<li>Yes</ul><table><tr><td>1<td>Yes<td>v%(n)d</table>%(x)s<p>Back to top"
    rows += [(100 + k, f"http://plain/{k}", plain % {"n": k, "x": notice if k else "<p>A passage that is quoted on some of the pages of the host only."}) for k in range(12)]
    rows += [(200 + k, f"http://some/{k}", f"<p>Story {k}" + ("<h2>References</h2><p>A passage that is quoted on some of the pages of the host only." if k < 6 else "") + f"<p>End {k}") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    quoted = "A passage that is quoted on some of the pages of the host only."
    for k in range(12):
        assert got[k] == f"Title {k} Story {k} References Source {k}"
        assert got[100 + k] == f"Title {k} Story {k} References Source {k} Yes 1 Yes v{k}" + ("" if k else " " + quoted)
    for k in range(20):
        assert got[200 + k] == f"Story {k} " + (f"References {quoted} " if k < 6 else "") + f"End {k}"
