import html
import re

from rulegrain.llm import lineblock, queries

LONG = "Words of a paragraph that goes on for quite a while so that the window over lines rises."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this long and winding page of ours, please agree to it all now.</div>
<div id="content"><h1>Title</h1><p>Short.</p><p>{LONG} a &amp; b&nbsp;c<br>d</p><p><b>{LONG}<p>End.</div>
<div class="sidebar"><p>{LONG}</p></div><form><p>{LONG}</p></form><script>var t="</p>";</script>
<div class="comments"><p>{LONG}</p></div><footer>&copy; {LONG}</footer>"""


def test_keeps_the_article_and_nothing_else():
    assert lineblock.main_text(PAGE) == f"Title\n\nShort.\n\n{LONG} a & b c d\n\n{LONG}\n\nEnd."


def test_odd_pages():
    for page in ("", "<p", "<script>x", "<!-- x", "</div></div>", "<nav><a>x</a>"):
        assert lineblock.main_text(page) == ""
    assert lineblock.main_text("<p>one</p>") == "one"
    assert lineblock.main_text("no markup  at\nall") == "no markup at all"
    assert lineblock.main_text("<p>a" * 20_000).count("a") == 20_000


def test_whole_table(spark):
    rows = {r.page_id: r for r in queries.op6_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_nulls_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", "<p>x</p>", "old")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in lineblock.extracted(df).collect()) == [("", 0), ("x", 1)]
    assert lineblock.extracted(df.limit(0)).count() == 0


def test_short_and_linked_lines_of_the_article_are_kept():
    long = LONG * 4
    for tag in ("article", "main", "div"):
        page = f'<body><div>Tagline</div><nav><p>A</p><p>B</p><p>C</p></nav><{tag}><p>{long}</p><div class="ad">Buy</div><p>Es be.</p><ul><li><a href="/s">Source</a></li></ul><p>End.</p></{tag}><div><a href="/x">More</a></div><footer>F</footer>'
        assert lineblock.main_text(page) == f"{long}\n\nEs be.\n\nSource\n\nEnd."
    assert lineblock.main_text(f'<p>{long}</p><div class="ad">Buy</div><p>Es be.</p><footer>F</footer>') == f"{long}\n\nEs be."


def test_articles_in_blocks_named_for_furniture_are_kept():
    for open_, close in (('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div class="with-nav">', "</div>"), ('<section id="discussion">', "</section>"), ('<div class="post legal">', "</div>"), ('<form class="search"><main>', "</main></form>")):
        page = f'<body><nav><a href="/">Home</a></nav>{open_}<h1 class="page-header">Title</h1><p>{LONG}</p><div class="sidebar"><p>Side.</p></div>{close}<footer>F</footer>'
        assert lineblock.main_text(page) == f"Title\n\n{LONG}", open_
    assert lineblock.main_text(f'<article><p>{LONG}</p></article><div class="comments"><p>{LONG * 3}</p></div>') == LONG
    assert lineblock.main_text(f"<html><head><title>T</title><body><p>{LONG}</p>") == LONG
    assert lineblock.main_text(f'<p>{LONG}</p><svg width="1"/><p>b</p><math/><p>c</p><svg><text>x</text></svg>') == f"{LONG}\n\nb\n\nc"


def test_quotes_and_names_in_attributes():
    for open_ in ("<p title=don't>", '<p title="a > b">', '<p data-x=5" wide>', '<p title="The hidden menu">', "<p data-hidden=no data-id='menu'>"):
        assert lineblock.main_text(f"<article><h1>Title</h1>{open_}{LONG}</p><p>It's \"{LONG}\"</p></article>") == f'Title\n\n{LONG}\n\nIt\'s "{LONG}"', open_
    for open_ in ("<p hidden>", "<p aria-hidden = 'TRUE'>", '<p STYLE="display: none">', "<p Class=menu>"):
        assert lineblock.main_text(f"<article><p>{LONG}</p>{open_}x</p></article>") == LONG, open_
    assert lineblock.main_text(f"<p>{LONG}</p><svg a='/>' b=\"c\"/><p>in</p>") == f"{LONG}\n\nin"
    assert lineblock.main_text("<svg " + "a='b' " * 20_000) == lineblock.main_text("<p " + 'a="b' * 20_000) == ""


COMMENT = f'<li class="comment"><article class="comment-body"><p>{LONG} I say.</p></article></li>'


def test_comment_sections_that_hold_articles_are_left_out():
    for open_, close in (('<div id="comments">', "</div>"), ('<section class="comments-area">', "</section>"), ("<section><h2>3 Comments</h2>", "</section>"), ("<div><h3>Leave a Reply</h3>", "</div>")):
        for tag in ("article", "main", "div"):
            page = f"<body><{tag}><h1>Title</h1><p>{LONG}</p><p>End.</p></{tag}>{open_}<ol>{COMMENT * 4}</ol>{close}<footer>F</footer>"
            assert lineblock.main_text(page) == f"Title\n\n{LONG}\n\nEnd.", (open_, tag)
    page = f'<div class="comments-open"><article><p>{LONG}</p></article></div><div class="comments"><article><p>{LONG}</p></article></div>'
    assert lineblock.main_text(page) == LONG
    assert lineblock.main_text(f"<article><h2>Comments</h2><p>{LONG}</p></article>") == f"Comments\n\n{LONG}"


def test_teasers_beside_the_article_are_left_out():
    page = f'<main><article><p>{LONG}</p><p>{LONG}</p></article><section class="related"><article><p>{LONG}</p></article></section></main>'
    assert lineblock.main_text(page) == f"{LONG}\n\n{LONG}"


def test_names_of_running_text_in_an_article_decide_nothing():
    for element in ('<p class="related">{}</p>', '<figcaption class="social">{}</figcaption>', '<h2 class="tag-line">{}</h2>', '<h3 id="notice">{}</h3>', '<aside class="pullquote">{}</aside>', "<aside><blockquote>{}</blockquote></aside>"):
        page = f"<article><p>{LONG}</p>{element.format('Said so.')}<p>{LONG}</p></article>"
        assert lineblock.main_text(page) == f"{LONG}\n\nSaid so.\n\n{LONG}", element
    for element in ('<p class="advert">{}</p>', '<div class="share">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<div class="related">{}</div>', '<aside class="related"><blockquote>{}</blockquote></aside>'):
        assert lineblock.main_text(f"<article><p>{LONG}</p>{element.format('Said so.')}<p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}", element


def test_articles_of_links_and_paragraphs_in_blocks_of_their_own():
    assert lineblock.main_text('<nav><a href="/">N</a></nav><article><p><a href="/a">One</a></p><p><a href="/b">Two</a></p></article>') == "One\n\nTwo"
    ad = '<div class="ad">Buy</div>'
    for wrap in ("<div>{}</div>", "<td>{}</td>"):
        page = wrap.format(f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>{ad}<div><p>Es be.</p></div>{ad}")
        assert lineblock.main_text(f"<body>{page}<footer>F</footer>") == f"{LONG}\n\n{LONG}\n\nEs be."
    assert lineblock.main_text(f"<body><div>Tagline</div>{ad * 3}<div><p>{LONG}</p></div>{ad}<div>Es be.</div>{ad}<div>{LONG}</div>") == f"{LONG}\n\nEs be.\n\n{LONG}"
