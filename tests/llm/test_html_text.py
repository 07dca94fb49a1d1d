from mathquarry.llm import html_text as h

text = lambda page, template=(): h.main_text(h.parse(page), set(template))


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Head</header><nav><ul><li>Menu</ul></nav>
    <article class="ad-free post"><h1>A &amp; B</h1><p><b>one  two<br><p>three&nbsp;&#233; <i>four</i>five<script>var t="</p>";</script>
    <div class="comments"><p>reader</p></div><aside>side</aside><form>f</form><ul><li>x<li>y</ul><table><tr><td>c<td>d</table>tail</article><footer>F</footer>"""
    assert text(page) == "A & B\none two\nthree é fourfive\nx\ny\nc\nd\ntail"


def test_odd_pages():
    assert text("") == "" and text("<") == "<" and text("plain &lt;text&gt;") == "plain <text>"
    assert text("<p>a<!-- c --><p>b<![CDATA[<x>]]>") == "a\nb<x>"
    assert text("<div hidden>no</div><p>yes</p></div></p>") == "yes"
    assert text("<article><p>cut <b>off") == "cut off"
    assert text("<main><p>m</p></main><p>outside</p>") == "m\noutside"
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<p title='a>b'>in</p><script>never closed <p>x") == "in"
    assert text("<article>one</article><div>between</div><article>two<article>inner</article></article>") == "one\nbetween\ntwo\ninner"
    assert text("<p it's>Hello</p><p a=b'c d='>' e>x") == "Hello\nx" and text("<p>a</p><p title='never closed") == "a"
    assert text("<p>\u0130</p><SCRIPT>var x = '</p>';</SCRIPT><p>rest</p>") == "\u0130\nrest"
    assert text("<article>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</article>") == "a x=1 b"
    assert text("<a =b='<i>'>c</a></ d><!-->e<!--->f</>") == "cef"


def test_articles_that_are_not_the_page_s_own():
    assert text('<main><p>a</p><article class="comment first">no</article><article hidden>no</article></main>') == "a"
    assert text('<article id="comments">no</article><article class="news comment-free">yes</article>') == "yes"
    assert text('<div class="with sidebar"><article>yes</article><div class="sidebar">no</div></div>') == "yes"
    assert text("<form><main>yes</main></form><form>no</form>") == "yes"


def test_pages_of_a_megabyte_take_linear_time():
    import time

    for part, end in (("<a ", "'"), ("<b>", "</i>" * 200_000), ("<p><b>x", ""), ('<i a="', ""), ("<![CDATA[", ""), ("<i><div>", "</i>" * 100_000), ("<", ""), ("</", ""), ("<!--", ""), ("<script>", ""), ("&", ""), ("<td>", ""), ("<a b = ", "")):
        page = part * (500_000 // len(part)) + end
        began = time.process_time()
        h.main_text(h.parse(page), set())
        assert time.process_time() - began < 10, part


def test_templates_of_a_host(spark):
    pages = []
    for i in range(30):
        body = f"<div><p>Welcome to our site</p><p>Our shop</p></div><div><p>Story number {i} of the day</p><p>Daily word</p></div>"
        pages.append((i, "http://www.site.example/" + str(i), f"<html><body>{body}</body></html>", "x"))
    pages += [(100 + i, "http://other.example/", f"<article><p>Same</p><p>{i}</p></article><div>Same</div>", "x") for i in range(12)]
    pages += [(200, "http://lone.example/", "<div><p>Welcome to our site</p></div>", "x"), (201, None, None, "x"), (202, "http://[bad", "<p>a</p>", "x"), (None, "", "", "x"), (5, *pages[5][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3)
    got = h.extract_pages(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert all(by[i] == f"Story number {i} of the day" for i in range(30))
    assert all(by[100 + i] == str(i) for i in range(12))  # inside of an article, too
    assert by[200] == "Welcome to our site" and by[201] == "" and by[202] == "a" and by[None] == ""
    was = h.TEMPLATE_BROADCAST
    try:
        h.TEMPLATE_BROADCAST = -1
        assert sorted(map(str, h.extract_pages(df).collect())) == sorted(map(str, got))
    finally:
        h.TEMPLATE_BROADCAST = was
    assert h.extract_pages(df.limit(0)).count() == 0


def test_articles_do_not_hide_what_is_around_them():
    assert text("<main><p>story</p><article>teaser card</article><p>more</p></main>") == "story\nteaser card\nmore"
    assert text("<div><p>body</p></div><article> &nbsp;</article>") == "body"
    assert text("<main></main><article>a</article>") == "a"
    assert text("<main><p>m</p></main><article>a</article>") == "m\na"


def test_lists_of_links_and_copied_articles(spark):
    rows = []
    for i in range(24):
        menu = "".join(f"<li><a href='/{i}{k}'>item {i * k}</a></li>" for k in range(4))
        sources = "".join(f"<li><a>source {i} {k}</a></li>" for k in range(4))
        rows.append((i, "http://a.example/", f"<body><div><ul>{menu}</ul></div><article><p>story {i % 3}</p><ul>{sources}</ul></article></body>", None))
    # three articles on eight pages each: their paragraphs stand often, but in three surroundings only
    rows += [(100 + i, "http://b.example/", f"<body><div>top {i}</div><article><p>story {i % 3}</p></article></body>", None) for i in range(24)]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert all(got[i] == "\n".join(f"source {i} {k}" for k in range(4)) for i in range(24))
    assert all(got[100 + i] == f"top {i}\nstory {i % 3}" for i in range(24))


def test_templates_hold_against_brute_force(spark):
    import random

    rng = random.Random(5)

    def block(depth):
        if depth == 0 or rng.random() < 0.4:
            return ("p", rng.choice(["Notice of the site", "Read on", "Again", f"own {rng.randrange(10**6)}"]))
        return (rng.choice(["div", "section", "article"]), *(block(depth - 1) for _ in range(rng.randrange(1, 4))))

    pages = [(f"h{rng.randrange(4)}.example", ("body", *(block(2) for _ in range(rng.randrange(1, 5))))) for _ in range(160)]
    pages += pages[:20]
    shown = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(shown, x[1:]))}</{x[0]}>"

    def placed(x, around):
        if not isinstance(x, str):
            yield x, around
            for y in x[1:]:
                yield from placed(y, x)

    def kept(x, gone):
        if isinstance(x, str):
            yield x
        elif x not in gone:
            for y in x[1:]:
                yield from kept(y, gone)

    want = []
    for host, page in pages:
        own = {p for at, p in pages if at == host}
        around = {}
        for p in own:
            for x, y in placed(p, None):
                if x[0] != "body" and "<article" not in shown(x):
                    around.setdefault(x, set()).add(y)
        gone = {x for x, found in around.items() if len(found) >= 4 and 3 * len(found) >= len(own)}
        want.append("\n".join(kept(page, gone)))
    rows = [(i, f"http://{host}/{i}", shown(page)) for i, (host, page) in enumerate(pages)]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == want
    assert any(len(t.split("\n")) < shown(p).count("</p>") for t, (_, p) in zip(want, pages))
