from weftline.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><div class="ad">Buy</div><!-- <p>no</p> -->
<div id="wrap"><article class="post"><h1>Head &eacute; &#x41;</h1><p>One <b>two</b>
 three<br>four<p>five <span class="promo">cheap</span> six</p><ul><li>a<li>b</ul><pre>x   y</pre><form><input>send</form>
<div class="comments"><p>first!</p></div><aside>see also</aside><table><tr><td>c1<td>c2</table></article></div>
<div id="cookie-notice">We use</div><footer>&copy; me</footer></body></html>"""


def test_blocks_of_an_article():
    assert html.main_text(PAGE, None) == "Head é A\nOne two three\nfour\nfive six\na\nb\nx y\nc1\nc2"
    assert html.main_text(PAGE[:PAGE.index("</article>")], None).endswith("c1\nc2")
    for broken in ("", "<", "<p", "</p>", "<p>a</div></b>c", "<!--", "<script>x", "<<<>>>", "a < b &bogus; &amp", "<div " * 50, "<div>" * 3000 + "deep"):
        assert isinstance(html.main_text(broken, None), str)
    assert html.main_text("<div>" * 3000 + "deep", None) == "deep"
    assert html.main_text("<body><div>short</div><p>no article &lt;here&gt;</p></body>", None) == "short\nno article <here>"


def test_alignment_finds_optional_and_repeated_groups_and_slots():
    def wrapper(*pages):
        whole = None
        for p in pages:
            one = html.stream(html.parse(p))
            whole = one if whole is None else html.align(whole, one)
        return html.regular_expression(whole)

    a, b = "<body><h1>x</h1><p>same</p></body>", "<body><h1>y</h1><p>same</p><p>more</p><dl><dt>k</dt></dl></body>"
    for pages in ((a, b), (b, a)):
        assert wrapper(*pages).replace("0", "") != ""
        out = wrapper(*pages)
        assert "<h1>#text</h1>" in out and "(<p>#text</p>)+" in out and "(<dl><dt>'" in out and "</dl>)?" in out
    one = html.stream(html.parse(a))
    assert html.align(one, one)[3] == [[*i[:2], i[2] * 2, *i[3:]] if i[0] is None else html.align(i, i) for i in one[3]]


def test_pages_share_the_wrapper_of_their_host(spark):
    body = "<html><body><div class='box'><p>menu {0}</p></div><div class='text'><p>{0} words of the text that go on</p></div></body></html>"
    rows = [(i, f"https://www.Site.example:80/{i}?q#f", body.format(f"page{i}"), "t") for i in range(8)]
    rows += [(20, "http://other.example", PAGE, "t"), (21, None, None, None), (22, "no url", "", "t"), (0, "http://www.site.example/", "<html><body>plain</body></html>", "t"), (None, "http://x.y", "<p>z</p>", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(4)
    out = html.extract(df).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in out}
    for i in range(8):
        text = f"page{i} words of the text that go on"
        assert got[i, rows[i][1]] == (text, len(text))
    assert got[21, None] == ("", 0) and got[22, "no url"] == ("", 0) and got[0, "http://www.site.example/"][0] == "plain" and got[None, "http://x.y"][0] == "z"
    assert html.extract(df.limit(0)).count() == 0


def test_every_page_gives_a_document(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = html.extract(pages).collect()
    # pages show a document under a heading; a few documents differ from the page by white space only
    same = sum(" ".join(r.text.split("\n", 1)[-1].split()) in {" ".join(t.split()) for t in texts} if i < 20 else r.text.split("\n", 1)[-1] in texts for i, r in enumerate(out))
    assert len(out) == pages.count() and same >= 0.95 * len(out)


def test_names_do_not_drop_the_main_part():
    text = "the words of the page that say what it is about"
    for page in ("<body class='no-sidebar'><p>{}</p></body>", "<main class='search-results'><p>{}</p></main>", "<article class='post has-comments'><p>{}</p><div class='comments'>first</div></article>",
                 "<div class='content-with-sidebar'><p>{}</p><div class='sidebar'>other pages</div></div>", "<div class='widget'><div class='share'>send</div><p>{}</p></div>"):
        assert html.main_text(f"<html>{page}</html>".format(text), None) == text
    assert html.main_text("<p>one <span class='search-term'>two</span> <b id='alert'>now</b> three</p>", None) == "one two three"


def test_ends_beyond_the_depth_close_their_own_elements():
    n = html.DEPTH + 50
    assert html.main_text("<article>" + "<div>" * n + "deep" + "</div>" * n + "<p>after</p></article><div>outside</div>", None) == "deep\nafter"
    nest = "<div>" * n + "deep<nav>menu<div>x</div></nav><p>a<p>b" + "</div>" * n
    assert html.main_text(f"<body><div><article>{nest}<p>after</p></article></div><p>outside</p></body>", None) == "deep\na\nb\nafter"


def test_the_host_decides_on_groups_by_their_names(spark):
    page = "<body><div class='promo-page'><p>{0} words of the text that go on</p></div><div class='promo'>buy {0}</div></body>"
    rows = [(i, "http://a.example/", page.format(f"page{i}")) for i in range(6)] + [(9, "http://a.example/", "<body><div class='promo-page'><p>short</p></div><div class='promo'>buy very many of all these things</div></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"page{i} words of the text that go on" for i in range(6)} | {9: "short"}
