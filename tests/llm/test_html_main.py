from pyspark.sql import functions as F

from tsdrift.llm import html_main as H

SCHEMA = "page_id long, url string, html string"


def text(html):
    return "\n".join(t for t, _ in H.parse(html))


def test_boilerplate_elements_go():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><a href="/">home</a></nav><div id="cookie-notice">We use cookies</div>
    <div class="ad-slot">Buy</div><article><header><h1>T&amp;t</h1><span>by me</span></header><p>One<br>two <a href=x>li</a>nk&nbsp;x
    <p>Three &lt;b&gt; &#233;&#x41;<ul><li>a<li>b</ul><div class="share">Share</div><form>f<input></form>
    <div class="comments"><article class="comment">c</article></div></article><aside>side</aside>
    <script>if (a<b) "</p>"</script><footer>foot</footer></body></html>"""
    assert text(page) == "T&t\nOne two link x\nThree <b> éA\na\nb"


def test_malformed_and_bare_pages():
    assert text(None) == "" and text("") == "" and text("just words  here") == "just words here"
    assert text("<p>x <b>y") == "x y" and text("a < b <!-- open") == "a < b" and text("<p>q</div></p>r") == "q\nr"
    assert text("<script>never closed <p>x") == "" and text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text("<main>m</main><p>out") == "m" and text('<p hidden>h<p style="display: none">n<p>s') == "s"
    assert text("<P CLASS=x>A<!-- <p>no</p> -->B</P>") == "AB"
    assert text("<div>" * 3000 + "deep") == "deep"


def test_article_text_is_not_lost_by_name():
    page = """<article class="post comments-open"><h2 id="search-algorithms">Search</h2><h2 id="related-work" class="share">Related</h2>
    <p class="share-price">Price</p><p>A <span class="notice">small</span> word</p><div class="share">Share</div>
    <div class="Social share">Us</div></article>"""
    assert text(page) == "Search\nRelated\nPrice\nA small word"
    assert text('<div class="nav-box">menu</div><h2 id="related-work">Related</h2><p>x') == "Related\nx"
    assert text('<article class="comment">c</article><p>x') == "x"


def test_markup_after_raw_text_is_read():
    page = '<script>var a = "<!-- ";</script><nav><a href="/">home</a></nav><p>One</p><!-- ad --><p>Two</p>'
    assert text(page) == "One\nTwo"
    assert text("<style>a<!-- b</style><footer>foot</footer><p>One <b>two</b>") == "One two"
    assert text('<script>if (a <b && c == "') == "" and text("<script>x <y </script><p>z") == "z"


def test_template_subtrees_of_a_host_go(spark):
    rows = [(i, f"http://a.org/{i}", f"<article><h1>Title {i}</h1><p>Own words number {i}</p><div><p>Follow our channel</p></div></article>")
            for i in range(12)]
    rows += [(50 + i, "http://a.org/copy", rows[0][2]) for i in range(30)]  # copies of one page are one page
    rows += [(100, "http://b.org/1", rows[1][2]), (101, None, rows[1][2]), (102, "http://[bad", None), (None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit("x"), "host": F.lit("y"), "blocks": F.lit(1)})
    got = {(r["page_id"], r["url"]): r for r in H.main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://a.org/3"]["text"] == "Title 3\nOwn words number 3"
    assert got[55, "http://a.org/copy"]["text"] == "Title 0\nOwn words number 0"
    assert got[100, "http://b.org/1"]["text"] == got[101, None]["text"] == "Title 1\nOwn words number 1\nFollow our channel"
    assert got[102, "http://[bad"]["text"] == "" and got[None, ""]["n_chars"] == 0
    assert got[3, "http://a.org/3"]["n_chars"] == len("Title 3\nOwn words number 3")


def test_thresholds(spark):
    rows = [(i, f"http://a.org/{i}", f"<p>Own {i}</p>" + ("<p>Shared</p>" if i < 8 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert "Shared" in {r["page_id"]: r["text"] for r in H.main_text(df).collect()}[0]  # 8 of 20 pages
    assert "Shared" not in {r["page_id"]: r["text"] for r in H.main_text(df, ratio=0.4).collect()}[0]
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
