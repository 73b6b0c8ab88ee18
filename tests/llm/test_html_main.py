from tagatlas.llm import html_main as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></ul></nav><!-- ad --><div class="ad">buy</div><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>A  title</h1><p><b>One &lt;two&gt;<br>three &amp four<p>Five <i>six</i>
seven.</p><div class="share">Tweet</div><ul><li>x<li>y</ul><form><input>Send</form><p>caf&eacute; &#x263a;</p></article>
<section id="comments"><p>First!</p></section><aside>more</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "A title\n\nOne <two> three & four\n\nFive six seven.\n\nx\n\ny\n\ncafé ☺"
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("plain & simple") == "plain & simple"
    assert H.main_text("<p>a<p>b<") == "a\n\nb<"
    assert H.main_text("<div>" * 5000 + "deep") == "deep"
    assert H.main_text("<body><div id=main><p>no article</p></div><div class='sidebar'>x</div>") == "no article"


def test_templates(spark):
    rows = [(k, f"https://a.example/{k}", f"<body><div><em>Our motto</em></div><div><p>page {k}</p><p>same words</p></div>") for k in range(20)]
    rows += [(100 + k, f"https://b.example/{k}", f"<article><p>Own {k}</p><p>A passage that many articles share</p><div><span>Rate this</span></div></article>") for k in range(20)]
    rows += [(200, "https://c.example/", "<div>Our motto</div>"), (201, None, None), (202, "x", ""), (None, "https://a.example/1", rows[1][2])]
    rows += [(300 + k, "https://d.example/copy", "<div><p>one page in many copies</p></div>") for k in range(30)]
    pages = spark.createDataFrame([r + ("old", 1) for r in rows], "page_id long, url string, html string, text string, _x int")
    got = H.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[k] == f"page {k}" for k in range(20)) and text[None] == "page 1"
    assert all(text[100 + k] == f"Own {k}\n\nA passage that many articles share" for k in range(20))
    assert (text[200], text[201], text[202], text[300]) == ("Our motto", "", "", "one page in many copies")
    assert H.extract(pages.limit(0)).count() == 0


def test_templates_of_a_large_host(spark):
    rows = [(k, f"https://a.example/{k}", f"<body>{'<div><em>Section menu</em></div>' if k % 20 == 0 else ''}<div><p>Own {k}</p></div><div><p>page {k}</p></div></body>") for k in range(2000)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 2000 and all(r.text == f"Own {r.page_id}\n\npage {r.page_id}" for r in got)


def test_articles_keep_shared_lists_and_copies(spark):
    shared = "<ul><li>flour</li><li>water</li></ul><table><tbody><tr><td>cell</td></tr></tbody></table><section><div><p>passage</p></div></section>"
    rows = [(k, f"https://a.example/{k}", f"<body><article><p>Own {k}</p>{shared}<div><span>Rate this</span></div></article></body>") for k in range(20)]
    rows += [(100 + k, f"https://b.example/{k}", f"<body><div><em>menu {k}</em></div><article><div class='body'><p>The whole story</p></div></article></body>") for k in range(20)]
    rows += [(200 + k, f"https://c.example/{k}", f"<body><div><em>menu {k}</em></div><article><div class='body'>Bare words<br>of a story</div></article></body>") for k in range(20)]
    text = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Own {k}\n\nflour\n\nwater\n\ncell\n\npassage" for k in range(20))
    assert all(text[100 + k] == "The whole story" and text[200 + k] == "Bare words of a story" for k in range(20))


def test_names_are_whole_and_references_stay_in_their_text():
    inside = "<article><p id='share-price'>a</p><div class='search-engines'>b</div><section class='article-header'>c</section><div class='share buttons'>no</div><p>AT&<b>amp;</b>T &amp;amp;</p></article>"
    assert H.main_text(inside) == "a\n\nb\n\nc\n\nAT&amp;T &amp;"
    assert H.main_text('<p title="abc>one') == ""
    assert H.main_text("<p title='a>b'>one</p><a href=x\"y>two</a>") == "one\n\ntwo"
    assert H.main_text("<div class='related'><article>teaser</article></div><article>story</article>") == "story"
    assert H.main_text("<div class='menu'><article>all there is</article></div>") == "all there is"


def plain_templates(pages, many):
    """For each host the subtrees, written out, that are on many different pages; a subtree in an article counts by article."""

    def write(n):
        return "<" + n.tag + ">" + "".join(write(c) if isinstance(c, H.Node) else "|" + " ".join(c.split()) for c in n.children) + "</>"

    def holds_prose(n):
        return n.tag in H.PASSAGES or any(isinstance(c, H.Node) and holds_prose(c) for c in n.children)

    count = {}
    for address, source in set(pages):
        site, root = (address or "").split("/")[2] if "//" in (address or "") else "", H.parse(source or "")
        articles, out, within = [], set(), set()

        def visit(n, inside):
            if n.tag in ("article", "main") and not inside:
                articles.append(write(n))
            if n.tag not in ("html", "body", "article", "main") and n.tag not in H.VOID and not (inside and (holds_prose(n) or n.tag in H.PROSE)):
                (within if inside else out).add(write(n))
            for c in n.children:
                if isinstance(c, H.Node):
                    visit(c, inside or n.tag in ("article", "main"))

        visit(root, False)
        for x in out:
            count.setdefault((site, x), set()).add(("page", source))
        for x in within - out:
            count.setdefault((site, x), set()).add(("article", tuple(articles)))
    return {k for k, v in count.items() if len(v) >= many}, write


def test_against_a_plain_counter(spark):
    import random

    rnd, rows = random.Random(4), []
    word = lambda: rnd.choice(["red", "green", "blue", "one", "two"])
    parts = [f"<div><span>{w}</span></div>" for w in ("menu", "about us", "terms")] + ["<ul><li>list</li></ul>", "<section><p>shared</p></section>", "<div>bare</div>"]
    for k in range(150):
        site = rnd.choice(["a", "b", "c"])
        body = "".join(rnd.choice(parts) if rnd.random() < 0.6 else f"<div><p>{word()} {word()}</p><em>{word()}</em></div>" for _ in range(rnd.randint(1, 6)))
        cut = rnd.randint(0, 3)
        rows.append((k, f"https://{site}.example/{k}", body if cut else f"<div>top {word()}</div><article>{body}</article>"))
    rows += [(1000 + k, r[1], r[2]) for k, r in enumerate(rows[:20])] + [(2000, None, rows[0][2]), (2001, "https://a.example/long", "<div>" + "<p>long text here</p>" * 20000 + "</div>")]
    templates, write = plain_templates([(u, h) for _, u, h in rows], 8)
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and len(got[2001].split("\n\n")) == 20000 and templates
    for i, address, source in rows:
        site, root = address.split("/")[2] if address else "", H.hashed(H.parse(source))
        gone = {n.key for n, _ in H._walk(root) if n.key is not None and (site, write(n)) in templates}
        assert got[i] == H.article_text(root, gone), i


def test_only_counts_can_tell(spark):
    """Pages without an article and without telling names or tags."""
    rows = [(k, f"https://a.example/{k}", f"<body><div><a>Start</a> <a>About</a></div><div>Story {k}<br>goes on</div><div>Made by us</div></body>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in H.extract(pages).collect()} == {f"Story {k} goes on" for k in range(9)}
    assert "Made by us" in H.extract(pages, many=10).first().text


def test_clashing_names(spark):
    names = ["row", "site", "page", "at", "outside", "inside", "articles", "tree", "gone", "h", "salt", "n", "of", "text", "n_chars"]
    df = spark.createDataFrame([(1, "u", "<p>x</p>", *range(len(names)))], ["page_id", "url", "html", *names])
    r = H.extract(df).first()
    assert (r.text, r.n_chars, r.html) == ("x", 1, "<p>x</p>") and all(r[c] == k for k, c in enumerate(names[:-2]))
    assert "html" not in H.extract(df, keep_html=False).columns


def test_names_of_what_goes():
    inside = lambda x: H.main_text(f"<article><p>story</p>{x}<p>end</p></article>")
    for name in ("class='reader-comments'", "id='comments-2'", "class='article-comments'", "class='ad-slot'", "class='ad-1'", "class='google_ads'", "class=notice", "class='cookie-notice'", "class='cookieBanner'", "id=footer", "role=search", "class='adUnit2'", "id='ReaderComments'"):
        assert inside(f"<div {name}><p>not of it</p></div>") == "story\n\nend", name
    for x in ("<p class='ad'>buy</p>", "<p>a <span class='ad'>buy</span></p>", "<article class='comment'><p>First!</p></article>"):
        assert "buy" not in inside(x) and "First" not in inside(x)
    assert inside("<section class='share'><p>Share prices.</p></section>") == "story\n\nShare prices.\n\nend"
    assert inside("<div class='share'><ul><li><a>Tweet this</a></li></ul></div>") == inside("<div class='share'>Tweet</div>") == "story\n\nend"
    for name in ("class='article-header'", "id='share-price'", "class='search-engines'", "class='adventure'", "class='commentary'", "class='header-2'"):
        assert inside(f"<div {name}>of it</div>") == "story\n\nof it\n\nend", name
    outside = lambda name: H.main_text(f"<body><div><p>story</p></div><div {name}><p>not of it</p></div></body>")
    for name in ("class='reader-comments'", "class='page-header2'", "class=topbar", "class='site_footer'", "id='mainNav'"):
        assert outside(name) == "story", name


def test_comments_end_as_they_do_in_browsers():
    assert H.main_text("<p>a<!-- c --!>b</p>") == "ab"
    assert H.main_text("<p>a<!-->b</p><!--->c<!-- > -- -->d") == "ab\n\ncd"
    assert H.main_text("<p>a<!-- never ends <p>b") == "a"


def test_a_post_beside_articles_of_comments():
    page = "<body><div class='post'><p>The post.</p></div><article class='comment'><p>A long comment that says much more than the post.</p></article></body>"
    assert H.main_text(page) == "The post."
    assert H.main_text("<div class='menu'><article>all there is</article></div><footer>f</footer>") == "all there is"
