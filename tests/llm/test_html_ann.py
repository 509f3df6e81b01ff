import numpy as np

from rfmspark.llm import html_text as H
from rfmspark.llm import rp_forest as R

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and we like them, very much indeed.</p></div>
<div id="main"><h1>A &amp; B</h1><p>First paragraph,&nbsp;with <b>bold<br>words</b> and   blanks.
<p>Second paragraph; it is long enough, as they are.<ul><li>item one<li>item two</ul>
<form><input><label>Mail</label></form><table><tr><td>x<td>y</table></div>
<aside><p>Side note, which is rather long, and has punctuation.</p></aside>
<div class="comments"><p>A reader says that this is great, really great, thank you.</p></div>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_its_surroundings():
    assert H.main_text(PAGE) == "A & B\nFirst paragraph, with bold words and blanks.\nSecond paragraph; it is long enough, as they are.\nitem one\nitem two\nx\ny"


def test_odd_pages():
    assert H.main_text("") == "" and H.main_text("<script>x") == "" and H.main_text("<b>") == ""
    assert H.main_text("plain < text & more") == "plain < text & more"
    assert H.main_text("<div><p>only one") == "only one"
    assert H.main_text("<a b='" * 50_000)[:2] == "<a"
    assert H.main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(H.main_text("<p>word, word. " * 50_000).split("\n")) == 50_000
    assert H.main_text("<article><header><h1>Head</h1></header><p>Text, one two.</p><footer>by</footer></article>") == "Head\nText, one two."


def test_heading_lead_sections_and_named_wrappers_stay():
    text = "".join(f"<p>Sentence {i}, which is long enough, as sentences in articles are; it goes on and on.</p>" for i in range(30))
    whole = "\n".join(f"Sentence {i}, which is long enough, as sentences in articles are; it goes on and on." for i in range(30))
    nav, foot = "<nav><a href=a>One</a></nav>", "<div class=comments><p>A reader says, well, that this is great.</p></div><footer>by</footer>"
    for open_, close in (("<article>", "</article>"), ("<div class=post>", "</div>")):
        assert H.main_text(f"<body>{nav}{open_}<h1>Head</h1><p>Lead, short.</p><div class=body>{text}</div>{close}{foot}") == f"Head\nLead, short.\n{whole}"
        assert H.main_text(f"<body>{nav}{open_}<div class=entry-header><h1>Head</h1></div><div class=body>{text}</div>{close}{foot}") == f"Head\n{whole}"
    two = f"<article><section class=a>{text}</section><section class=b><p>The rest, which is short, ends here.</p></section></article>"
    assert H.main_text(f"<body>{nav}{two}{foot}") == f"{whole}\nThe rest, which is short, ends here."
    for name in ("paywall", "category-social"):
        assert H.main_text(f"<body>{nav}<div class='{name}'>{text}</div>{foot}") == whole


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (2, None, None, 0), (None, "u", "<p>x</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    assert [g[3] for g in got if g[0] == 2] == [0, 0] and (None, "u", "x", 1) in got and len(got) == 4
    assert H.extract(pages.where("false")).count() == 0


def test_given_pages_match_their_articles(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9:].partition("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", p))).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != ids[q])[:k]


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = R.nearest(rows, rows.where("vec_id % 20 = 0")).collect()
    data = rows.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in data], float), [r["vec_id"] for r in data]
    hits = total = 0
    for q in [i for i, v in enumerate(ids) if v % 20 == 0]:
        want = brute(x, ids, q, 10)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        for _, v, s in mine:
            assert abs(s - np.sqrt(((x[ids.index(v)] - x[q]) ** 2).sum())) < 1e-12
        hits += len({v for _, v in want} & {m[1] for m in mine})
        total += 10
    assert hits / total >= 0.9


def test_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 3)
    rows = [(i, [1.0, 2.0, 0.0], 1) for i in range(40)] + [(100 + i, [float(i + 1), 0.0, 0.0], 1) for i in range(5)]
    rows += [(200, None, 1), (201, [0.0, 0.0, 0.0], 1), (202, [1.0, None, 2.0], 1), (203, [float("nan"), 1.0, 1.0], 1), (204, [1.0], 1), (None, [1.0, 2.0, 0.0], 1), (3, [1.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in R.nearest(df, df.where("vec_id in (0, 39, 100, 200, 201, 204)")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {0, 39, 100}
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11)) and [v for _, v, _ in sorted(got[39])] == list(range(10))
    assert [v for _, v, _ in sorted(got[100])] == [101, *[0, 1], *range(2, 9)] or sorted(got[100])[0][1] == 101
    few = df.where("vec_id in (0, 100, 101)")
    assert sorted((r["query_id"], r["vec_id"]) for r in R.nearest(few, few).collect()) == [(0, 100), (0, 101), (100, 0), (100, 101), (101, 0), (101, 100)]
    assert R.nearest(df.where("false"), df.where("false")).count() == 0
