"""Main text of pages."""

from html import unescape

import pytest

from cloakwork.llm import htmltext
from cloakwork.llm.htmltext import main_text

ARTICLE = "<h1>Title &amp; more</h1><p>First para, with commas, and words enough to be counted.<p>Second  para\n here &eacute;&#39;s more, running on and on.</p>"
TEXT = "Title & more First para, with commas, and words enough to be counted. Second para here é's more, running on and on."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body>{MENU}<article>{ARTICLE}</article><footer>&copy; x</footer></body></html>",
        f'<body><div class="menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="content">{ARTICLE}</div><div class="footer">Foot, note, and, so on</div>',
        f'<body><main>{ARTICLE}<div class="ad">Buy, buy, now, cheap, very cheap</div></main><aside><p>Side, text, that is rather long, and goes on</p></aside>',
        f'<body><header><h2>Site</h2></header><article>{ARTICLE}<form><p>Your mail, please, it is needed here</p></form><script>if (a<b) {{ p("</p>") }}</script></article>',
        f'<body><article>{ARTICLE}<section id="comments"><p>Reader: I, for one, think this is bad, and say so</p></section></article>',
        f'<body><div class="cookie-notice"><p>We use cookies, and so on, and so forth, please agree.</p></div><div id="post">{ARTICLE}</div><div class="sidebar"><ul><li><a href=x>more</a></ul></div>',
        f"<body><article>{ARTICLE}<!-- <p>old, text</p> --><style>p{{x:y}}</style>",
        f'<body><article>{ARTICLE}<div style="display:none">secret, hidden, text, here</div><p hidden>gone, too</p></article>',
    ],
)
def test_article_alone_is_kept(html):
    assert main_text(html) == TEXT


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain &lt; text", "plain < text"), ("<script>x", ""), ("<p>a<b>b</b>c<br>d", "abc d"), ("<", "<"), ("a < b", "a < b")])
def test_odd_inputs(html, text):
    assert main_text(html) == text


def test_inline_tags_do_not_split_words_and_blocks_do():
    assert main_text("<article><p>on<b>e</b> t<i>w</i>o</p><ul><li>x</li><li>y</li></ul><table><tr><td>a<td>b</table></article>") == "one two x y a b"


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + "deep text, quite deep indeed" + "</div>" * 5000) == "deep text, quite deep indeed"
    long = " ".join(f"w{i}," for i in range(50_000))
    assert main_text(f"<body>{MENU}<article><p>{long}</p></article></body>") == long


def test_references_are_decoded_once():
    assert main_text("<p>&amp;lt; &#x41; &nbsp;x &bogus; &am</p>") == " ".join(unescape("&amp;lt; &#x41; &nbsp;x &bogus; &am").split())


def test_frame(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "z"), (1, "u", f"<article>{ARTICLE}</article>", "z"), (None, None, None, None), (3, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, TEXT, len(TEXT))] * 2 + [(0, "", 0), (3, "", 0)])
    assert htmltext.extract(df.limit(0)).count() == 0


LONG = "<p>One paragraph, of some length, that runs on and on.</p><p>Another one, of some length too, which also runs on.</p>"
PLAIN = "One paragraph, of some length, that runs on and on. Another one, of some length too, which also runs on."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article><p class=a'>A quote in a bare value, and all of this text stays.</p><p title=\"x>y\">And this one, too.</p>{LONG}</article>", f"A quote in a bare value, and all of this text stays. And this one, too. {PLAIN}"),
        (f'<p data-x="it\'s" id=\'a"b\'>Mixed quotes, in one tag, are fine.</p>{LONG}', f"Mixed quotes, in one tag, are fine. {PLAIN}"),
        (f'<article><h1>T</h1><p class="tags-intro">What tags are for, in a few words.</p>{LONG}<section class="related-work"><h2>Related work</h2><p>Others did this before, and well.</p></section></article>', f"T What tags are for, in a few words. {PLAIN} Related work Others did this before, and well."),
        (f'<body><div class="article-header"><h1>Title</h1></div><div class="article-body">{LONG}</div><div class="article-footer"><a href="/x">Next</a></div></body>', f"Title {PLAIN}"),
        (f"<div><div id=menu><a href=a>A</a></div>{LONG}Bare text between, with <b>some</b> bold.<p>A last paragraph, after the bare text, of some length.</p></div>", f"{PLAIN} Bare text between, with some bold. A last paragraph, after the bare text, of some length."),
        (f'<body class="no-sidebar"><form id="aspnetForm" action="/"><input type=hidden><article>{LONG}</article><button>Send</button></form></body>', PLAIN),
        (f'<div class="share-price-study"><p>Shares rose, and then fell, as the study says.</p>{LONG}</div>', f"Shares rose, and then fell, as the study says. {PLAIN}"),
        (f'<article>{LONG}<div class="tag-cloud-new"><a href=1>one</a> <a href=2>two</a></div><div class="newsletter-invite"><p>Sign up, please, for our letter.</p><input></div></article>', PLAIN),
    ],
)
def test_names_are_evidence_only(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("name", ["menu", "main-menu", "navBar", "topbar", "site-footer", "sidebar left", "cookie-notice", "gdpr-consent-banner", "post-comments", "comment-list", "commentlist", "ad", "ad-container", "advert_box", "social-share-buttons", "related", "newsletter-form", "breadcrumbs", "promo-box", "notice", "entry-tags"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_parts_named_by_page_builders_go(name, attribute):
    part = f'<div {attribute}="{name}"><p>Words of this part, some of them, with commas, and an end.</p></div>'
    assert main_text(f"<body>{part}<div id=x1>{LONG}</div>{part}</body>") == PLAIN
    assert main_text(f"<body><article>{LONG}{part}</article></body>") == PLAIN


def test_time_is_linear_in_depth():
    import time

    for inside in ("<div>some words, and more of them, to score {}</div>", "<p>some words, and more of them, to score {}"):
        html = "<body>" + "<div>".join(inside.format(i) for i in range(20_000))
        began = time.process_time()
        text = main_text(html)
        assert time.process_time() - began < 3 and text.count("some words") >= 10_000


def test_sums_agree_with_plain_recursion():
    import random

    rng = random.Random(4)

    def build(depth):
        tag = rng.choice(["div", "div", "section", "article", "p", "li", "a href=x", "span", "b", "aside", 'div class="post"', 'div class="tags-x"'])
        inside = "".join(build(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>{' '.join(['word,'] * rng.randint(0, 9))}{inside}</{tag.split(' ')[0]}>"

    for _ in range(200):
        nodes = htmltext.parse(build(4))
        htmltext.drop_doubtful(nodes)
        found = htmltext.blocks(nodes[0])
        htmltext.weigh(nodes, found)

        def size(node, linked=False):
            total = 0
            for x in node.items:
                if isinstance(x, str):
                    total += len(x) * (not x.isspace()) * (not linked or node.link)
                elif not x.out:
                    total += size(x, linked and not node.link)
            return total

        def score(node):
            total = 0.0
            for text, owner in found:
                if len(text) < 25 and owner.tag not in htmltext.PARAGRAPHS:
                    continue
                share, up = 1.0, owner.parent if owner.tag in htmltext.PARAGRAPHS else owner
                while up is not None and up is not node:
                    share, up = share / 2, up.parent
                if up is node:
                    total += share * (1.0 + text.count(",") + min(len(text) / 100, 3.0))
            return total + node.bonus if total else 0.0

        for node in nodes:
            assert node.score == pytest.approx(score(node)) and (node.size, node.linked) == (size(node), size(node, True) if not node.link else size(node))
