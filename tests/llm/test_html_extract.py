"""Main text of pages whose article is known."""

import math

import numpy as np
import pytest

from plumbline.llm import html_extract
from plumbline.llm.html_extract import main_text

P = "A paragraph of the story, with enough words in it to be told from a menu &amp; such."
P2 = "Another one follows it,\n  spread   over lines, with &eacute;t&eacute; and &#8364;5 in it."
WANT = "The title\n" + P.replace("&amp;", "&") + "\nShort.\n" + "Another one follows it, spread over lines, with été and €5 in it."
BODY = f"<h1>The title</h1><p>{P}</p><p>Short.</p><p>{P2}</p>"
NAV = "<nav><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta beta</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 somebody, all rights reserved, a long line of legal words here</footer>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>t</title><style>p{{}}</style><script>var t='<p>no</p>';</script></head><body>{NAV}<article>{BODY}</article>{FOOT}</body></html>",
        f"<body><header><h2>Site</h2><p>A slogan that nobody has ever read to the end of it.</p></header>{NAV}<div class='content'>{BODY}</div><div class='sidebar'><p>{P}</p></div>{FOOT}",
        f"<body>{NAV}<main><article>{BODY}</article><section id='comments'><p>First! {P}</p></section><form><p>Write to us about it all, please do so</p><input></form></main>{FOOT}",
        f"<body><div class='cookie-notice'><p>We use cookies and we use many of them, as you can see here.</p></div><div class=ad>Buy it<div id=post>never</div></div><article>{BODY}<aside><p>{P}</p></aside><div class='share-buttons'>Share</div></article>",
        f"<body><div class='ad'>unclosed <article>{BODY}</article>{FOOT}",
        f"<div hidden>{P}</div><!-- {P} --><article>{BODY.replace('</p>', '')}</article>",
    ],
)
def test_articles(html):
    assert main_text(html) == WANT


def test_pieces_do_not_matter():
    html = f"<body>{NAV}<article>{BODY * 40}</article>{FOOT}"
    assert "\n".join(x.text for x in html_extract.lines_of(html)) == "\n".join(x.text for x in html_extract.lines_of(html, piece=7))


@pytest.mark.parametrize("html", ["", "   ", "<", "<nav><a>x</a></nav>", "<script>if (a<b) {}", "&am"])
def test_without_content_or_broken(html):
    assert main_text(html) in ("", "<", "&am")


def test_query_handles_odd_rows(spark):
    page = f"<body>{NAV}<article>{BODY}</article>{FOOT}"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", f"<article><p>{'long ' * 100_000}</p></article>", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = sorted(((r.page_id or 0, r.n_chars) for r in got.collect()))
    assert by == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 0), (3, 499_999)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "".join(f"<p>Paragraph {i} of the story, with enough words in it to be told from a menu and such things.</p>" for i in range(40))
TOLD = [f"Paragraph {i} of the story, with enough words in it to be told from a menu and such things." for i in range(40)]


@pytest.mark.parametrize(
    "html",
    [
        f"<body>{NAV}<article><h1>T</h1><p>A lead.</p><div>{STORY}</div><p>The end.</p></article>{FOOT}",
        f"<body>{NAV}<article><h1>T</h1><section><p>A lead.</p></section><section>{STORY}</section><section><p>The end.</p></section></article>{FOOT}",
        f"<body>{NAV}<main><h1>T</h1><p>A lead.</p><blockquote>{STORY}</blockquote><p>The end.</p></main>{FOOT}",
        f"<body>{NAV}<div class=post><h1>T</h1><p>A lead.</p><div>{STORY}</div><p>The end.</p></div>{FOOT}",
        f"<body>{NAV}<h1>T</h1><p>A lead.</p>{STORY}<p>The end.</p>{FOOT}",
    ],
)
def test_nothing_outside_the_long_part_is_lost(html):
    assert main_text(html).split("\n") == ["T", "A lead.", *TOLD, "The end."]


HEAD, TAIL = "<p>A lead that is long enough to be a sentence of its own, more or less.</p>", "<p>A last paragraph that is long enough to be one, and then the story ends.</p>"
LEAD, LAST = HEAD[3:-4], TAIL[3:-4]


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<h2 id="related-work">Related work</h2><p>Of others.</p>', ["Related work", "Of others."]),
        ('<h2 id="social-impact" class="tags">Social impact</h2>', ["Social impact"]),
        ('<section id="related-work"><h3>Of others</h3>' + "<p>Much has been written by others, and some of it is good.</p>" * 4 + "</section>", ["Of others"] + ["Much has been written by others, and some of it is good."] * 4),
        ('<p class="left side">Beside a picture.</p>', ["Beside a picture."]),
        ("<ul>" + "".join(f'<li><a href="/{i}">Source number {i}</a></li>' for i in range(5)) + "</ul>", [f"Source number {i}" for i in range(5)]),
        ('<div class="notice-board-story"><p>On a board.</p></div>', ["On a board."]),
        ('<p class="advert">Buy it now.</p><div class="related-links"><a href="/x">More of it</a></div><ul id="shareButtons"><li>Share</li></ul>', []),
        ('<form><p>Write to us.</p><input name=a><textarea></textarea></form>', []),
    ],
)
@pytest.mark.parametrize("frame", ["article", "div"])
def test_names_inside_the_article(inner, want, frame):
    html = f"<html><body>{NAV}<{frame}><h1>The title</h1>{HEAD}{inner}{STORY}{TAIL}</{frame}>{FOOT}</body></html>"
    assert main_text(html).split("\n") == ["The title", LEAD, *want, *TOLD, LAST]


def test_the_title_in_a_header_of_the_post():
    html = f'<body>{NAV}<article><div class="post-header"><h1>T</h1></div>{STORY}</article>{FOOT}'
    assert main_text(html).split("\n") == ["T", *TOLD]
    html = f'<body>{NAV}<article><div class="masthead"><h1>T</h1></div>{STORY}</article>{FOOT}'
    assert main_text(html).split("\n") == ["T", *TOLD]


def test_a_form_around_the_page():
    html = f'<body><form id="aspnetForm"><input type=hidden><input>{NAV}<div><h1>T</h1>{STORY}</div><form>{FOOT}'
    assert main_text(html).split("\n") == ["T", *TOLD]


@pytest.mark.parametrize("told", ["3 Comments", "Comments (3)", "Leave a reply", "No comments"])
def test_reader_comments_in_a_plain_list(told):
    html = f"<body>{NAV}<div><h1>T</h1>{STORY}<h3>{told}</h3><ol><li><p>I have read all of it, and I liked every single word in it, really.</p><li>So did I.</ol></div>{FOOT}"
    assert main_text(html).split("\n") == ["T", *TOLD]


def test_ratios_and_smoothing_are_those_of_plain_loops():
    page = f"<body>{NAV}<article>{BODY}<p><a href=x>Linked as a whole</a></p><p><b>Bold</b> and <i>not</i></p></article>{FOOT}"
    lines = html_extract.lines_of(page)
    own = [0.0 if x.out or x.linked * 2 > len(x.text) else len(x.text) / (x.tags or 1) for x in lines]
    assert list(html_extract.ratios(lines)) == own
    even = []
    for i in range(len(own)):
        weights = {j: math.exp(-0.5 * ((i - j) / 1.5) ** 2) for j in range(len(own)) if abs(i - j) <= 4}
        even.append(sum(w * own[j] for j, w in weights.items()) / sum(weights.values()))
    assert list(html_extract.smooth(np.array(own))) == pytest.approx(even)
    chosen = np.array([e >= 0.5 * sum(even) / len(even) and o > 0 for e, o in zip(even, own)])
    region = html_extract.content_region(lines, chosen)
    assert region[1] == "article" and main_text(page).split("\n")[:2] == WANT.split("\n")[:2]


def test_sections_of_unequal_length_stay():
    first = "<p>The first section is a short one, yet it has a sentence that is as long as any other here.</p>" * 3
    html = f"<body>{NAV}<div><section>{first}</section><section>{STORY}</section></div>{FOOT}"
    assert len(main_text(html).split("\n")) == 43


def test_a_class_word_alone_hides_no_article():
    article = [" ".join(f"word{i}x{j} and more of it" for j in range(20)) for i in range(6)]
    body = "".join(f"<p>{p}</p>" for p in article)
    for kind in ("content with-sidebar", "post has-comments", "layout no-sidebar"):
        page = f'<html><body><div class="menu"><a href="/">Home</a> <a href="/x">News</a></div><div class="{kind}"><h1>Title</h1>{body}<div class="comments"><p>First! I liked this a lot.</p></div></div><div class="sidebar"><p>Weather and other things</p></div></body></html>'
        assert html_extract.main_text(page) == "\n".join(["Title", *article])
