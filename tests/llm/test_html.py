from pyspark.sql import functions as F
from sessionlake.llm import html, queries


def text(page):
    return html.main_text(page.encode())


P = "This is a paragraph of the article, which is long enough, and has commas, to be taken for one."


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>{P}</p>';</script></head><body>{body}</body></html>"


def test_article_only():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>{P}</p></div>
    <div id=content><article><h1>Title</h1><p>One &amp; two&nbsp;three<br>four.</p><p>{P}<p>Sh is.</p><form><p>{P}</p></form><aside>{P}</aside></article>
    <section id="comments"><p>{P} {P}</p></section></div><div class="sidebar"><p>{P}</p></div><footer>&copy; x</footer>"""
    assert text(page(body)) == f"Title\nOne & two three four.\n{P}\nSh is."


def test_containers_without_semantics():
    body = f"<div class=menu><a href=1>{P}</a></div><table><tr><td><div><p>{P}</p><p>short</p><div>{P}</div></div></td></tr></table><div><a href=x>link link link link</a></div>"
    assert text(page(body)) == f"{P}\nshort\n{P}"
    assert text(page(f"<div>{P}<br><br>{P}</div>")) == f"{P}\n{P}"
    assert text("just text, no markup") == "just text, no markup"
    assert text(f"<p>{P}</p><p>{P}</p>") == f"{P}\n{P}"


def test_broken_markup():
    assert text("") == text("<") [:0] == ""
    assert text(f"<div><p>{P}</div></p></span></div>") == P
    assert text(f"<article><p><b>{P}<br><p>x <i>y</i>z</p>") == f"{P}\nx yz"
    assert text(f"<p>{P}</p><script>never closed <p>no</p>") == P
    assert text(f"<p>{P}</p><!-- never closed <p>no</p>") == P
    assert text(f"<p title='a>b' class=\"x\">1 < 2 & 3 > 2 &am &amp ok</p><p>{P}</p>").startswith("1 < 2 & 3 > 2 &am & ok")
    assert text(f"<p>{P}</p><p") == P


def test_long_and_deep_pages_take_linear_time():
    assert text("<div>" * 50_000 + P + "</div>" * 50_000) == P
    assert text("<div>" * 20_000 + P + "</span></b></li>" * 20_000) == P
    assert len(text("<p>" + P + "</p>" + "<" * 50_000)) >= len(P)
    assert text("<article>" + f"<p>{P}</p>" * 5_000 + "</article>").count("\n") == 4_999
    html.main_text(b"<a b='" * 20_000)


def test_query_keeps_the_article(spark, sf):
    rows = queries.op9_html_text(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import re
    from html import unescape

    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "<p>a</p>", None)], "page_id long, html string, text string").withColumn("N_CHARS", F.lit("clash"))
    got = html.extract(df)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "a", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html.extract(df.limit(0)).count() == 0


def test_modifiers_name_no_role():
    for wrapper in ('class="layout has-sidebar"', 'id="page-with-rail"', 'class="no_footer"'):
        assert text(page(f"<div {wrapper}><article><p>{P}</p></article></div>")) == P, wrapper
    assert text(page(f'<p>{P}</p><div class="sidebar"><p>{P}</p></div>')) == P


def test_short_parts_of_an_article_stay():
    long = f"<p>{P}</p>" * 20
    got = text(page(f"<article><h1>Title</h1><section><h2>One</h2><div>{long}</div></section><section><h2>Two</h2><p>Short.</p></section><ul><li><a href=x>See this link</a></ul></article>"))
    assert got.split("\n") == ["Title", "One", *[P] * 20, "Two", "Short."]


def test_wrappers_of_the_page_stay():
    body = f"<h1>Title</h1><p>{P}</p><p>{P}</p>"
    whole = f"Title\n{P}\n{P}"
    side = f'<div class="sidebar"><p>{P}</p></div>'
    for opened, closed in (('<div class="sidebar">', "</div>"), ("<form action=x>", "</form>"), ('<div class="nav-layout"><form><div id=overlay>', "</div></form></div>"), ("<header>", "</header>")):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<article>{body}</article>{side}", f"<div>{body}<p>{P}</p></div>"):
            expected = whole + f"\n{P}" if inner.startswith("<div") else whole
            assert text(page(opened + inner + f"<input name=q>{closed}")) == expected, (opened, inner)


def test_boilerplate_that_outweighs_the_article_goes():
    big = f"<p>{P}</p>" * 30
    for boilerplate in (f'<div class="sidebar">{big}</div>', f"<form>{big}</form>", f'<div class="related"><article>{big}</article></div>', f'<section id="comments">{big}</section>'):
        assert text(page(f"<article><h1>Title</h1><p>{P}</p></article>{boilerplate}")) == f"Title\n{P}"
        assert text(page(f"<article><h1>Title</h1><p>{P}</p>{boilerplate}</article>")).startswith(f"Title\n{P}")
    cards = "".join(f"<article><p>{P}</p></article>" for _ in range(9))
    assert text(page(f'<div><p>{P}</p><p>{P}</p><p>{P}</p></div><div class="related">{cards}</div>')) == f"{P}\n{P}\n{P}"
    assert text(page(f'<form><label>Name, please</label><p>{P}</p></form>')) == ""
    assert text(page(f'<div class="cookie-notice"><p>{P}</p></div>')) == ""
    assert text("<div class=sidebar>" * 20_000 + f"<p>{P}</p>" * 5 + "</div>" * 20_000).count(P) == 5


LONG = "This is a long sentence, with commas, and it goes on for a while so that it counts. " * 6


def test_pages_without_an_article_keep_short_parts_beside_the_long_one():
    text = LONG.strip()
    for page, want in (
        (f"<main><h1>Title</h1><div>{LONG}</div><p>Short end.</p></main>", ["Title", text, "Short end."]),
        (f"<nav><a href=x>menu</a></nav><div id=content><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Short.</p></section></div><footer>foot</footer>", ["One", text, "Two", "Short."]),
        (f"<div id=page><div><div><h1>Head</h1><p>{LONG}</p><p>End.</p></div></div></div><div class=sidebar><p>{LONG}</p></div>", ["Head", text, "End."]),
        (f"<main><div><p>{LONG}</p></div><ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>Last.</p></main>", [text, "Last."]),
    ):
        assert html.main_text(page.encode()).split("\n") == want


def test_compound_names_inside_an_article():
    page = f"<article><h1>T</h1><div class='search-engines'><p>{LONG}</p><p class='copyright-law'>The law.</p><p id='ad-hoc'>A rule.</p><p class='copyright'>(c)</p><div class='related-posts'><p>More</p></div></div></article>"
    assert html.main_text(page.encode()).split("\n") == ["T", LONG.strip(), "The law.", "A rule."]
