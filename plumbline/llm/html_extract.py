"""Main text of web pages, from text-to-tag ratios over a parser's events.

The standard library's streaming parser yields events; each block of a page becomes a line with its text, its number of tags and the
elements it stands in. Lines in menus, headers, footers, asides, notices, adverts and comments count with no text. A class or id tells of such an element only if
all of its words do, never for a heading, hardly for a paragraph, not where it holds the article's title, and not where it holds half of the page's unlinked
text or more, in several blocks, and no article or main element is outside it. A form is one only if its fields, not text, fill it; reader comments are also
known by a heading that counts or asks for them. A line's ratio of text to tags is smoothed with a Gaussian over its neighbours; lines above a threshold are clustered. Where the element that holds nearly all of
them is part of an article, that is the content region, else the smallest element that holds all of them, widened as long as that adds
nothing that is left out. The region's blocks are the text: so leads, headings and short paragraphs stay with their long neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import batched, rows

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video head title nav footer aside button select textarea dialog menu search".split())
REGIONS = frozenset("article main section div td body blockquote center".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pager pagination header masthead topbar footer foot copyright legal comment comments commentlist reply replies respond disqus "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login widget skip toolbar tags".split()
)
#: Words that may stand beside those without a meaning of their own; ``post-header`` or ``with-sidebar`` have others.
BESIDE = frozenset("area bar block blocks bottom box btn button buttons col column container footer form global group holder icon icons inner item items label left link links list lists main media module more news outer panel posts articles stories primary region right row secondary section site social stories top us widget widgets wrap wrapper".split())
SURE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr copyright comment comments share sharing breadcrumb breadcrumbs newsletter".split())  # of a paragraph
FIELDS = frozenset("input select textarea button".split())
FORM_TEXT = 200  # letters outside links for each field, beyond which a form is a page's frame and not a form
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WIDTH = 1.5  # of the Gaussian, in lines
THRESHOLD = 0.5  # of the mean smoothed ratio
MOST = 0.5  # of a page's unlinked text, with which an element is content whatever its class is called
SHARE = 0.9  # of the clustered text that an element holds whose article is the content region

_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_READERS = re.compile(r"\W*(\d+|no|one|leave an?|post an?|add an?|write an?|join the)\s+(comments?|reply|replies|responses?|conversation|discussion|kommentare?|commentaires?|comentarios?)\b|(comments?|replies|responses?|kommentare?|commentaires?|comentarios?)\s*\(\d+\)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """A block: its text, tags, letters inside links, the regions it is in (number and tag, outermost first), a heading's level or none, whether it is left out, and the elements around it whose class or id speaks of something else than content."""

    parts: list[str] = field(default_factory=list)
    text: str = ""
    tags: int = 0
    linked: int = 0
    regions: tuple[tuple[int, str], ...] = ()
    heading: int = 0
    out: bool = False
    named: tuple[int, ...] = ()


class _Events(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # open elements: tag, whether they are left out, their number if that is for their name, whether they are regions
        self.named: list[int] = []
        self.fields: dict[int, int] = {}  # of each form by its number
        self.hard = self.names = 0
        self.regions: list[tuple[int, str]] = []
        self.out = self.links = self.made = self.articles = 0
        self.line = Line()

    def _flush(self) -> None:
        line = self.line
        line.text = " ".join("".join(line.parts).split())
        line.parts = []
        if line.text or line.tags:
            self.lines.append(line)
        self.line = Line()
        self._stand()

    def _stand(self) -> None:
        """The line stands in the elements that are open now."""
        self.line.regions, self.line.out, self.line.named = tuple(self.regions), self.hard > 0, tuple(self.named)

    def _left_out(self, tag: str, attrs: list) -> bool:
        if tag in NEVER:
            return True
        if tag == "header" and not self.articles:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value)):
                return True
            if name == "role" and value and value.lower() in ROLES:
                return True
        return False

    def _named_so(self, tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "main", "article") or tag in HEADINGS:
            return False
        told = [token for name, value in attrs if value and (name == "class" or (name == "id" and tag != "p")) for token in value.split()]
        return any(_speaks(token, SURE if tag == "p" else WORDS) for token in told)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in ("article", "main"):  # an element that was never closed doesn't hide the article
                while self.stack and self.out:
                    self._pop()
                self._stand()
        elif tag in ("br", "td", "th"):
            self.line.parts.append(" ")
        self.line.tags += 1
        if tag in FIELDS and ("type", "hidden") not in attrs:
            self.fields.update({n: self.fields[n] + 1 for n in self.named if n in self.fields})
        if tag in VOID:
            return
        hard, region = self._left_out(tag, attrs), tag in REGIONS
        out = hard or tag == "form" or self._named_so(tag, attrs)
        if tag in ("p", "li") and not out:
            self.line.heading = 0
            return
        number = 0
        if out and not hard:
            self.names += 1
            number = self.names
            self.named.append(number)
            if tag == "form":
                self.fields[number] = 0
        self.stack.append((tag, out, number, region))
        self.out += out
        self.hard += hard
        self.articles += tag == "article"
        self.links += tag == "a"
        if region:
            self.made += 1
            self.regions.append((self.made, tag))
        if tag in BLOCKS:
            self._stand()
            self.line.heading = int(tag[1]) if tag in HEADINGS else 0

    def _pop(self) -> str:
        tag, out, number, region = self.stack.pop()
        self.out -= out
        self.hard -= out and not number
        if number:
            self.named.pop()
        self.articles -= tag == "article"
        self.links -= tag == "a"
        if region:
            self.regions.pop()
        return tag

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.stack):
            if tag in BLOCKS:
                self._flush()
            while self._pop() != tag:
                pass
            if tag in BLOCKS:
                self._stand()
        elif tag in BLOCKS:
            self._flush()
        elif tag in ("td", "th"):
            self.line.parts.append(" ")
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.out and any(t in ("script", "style", "template", "svg") for t, *_ in self.stack[-1:]):
            return
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)


def _speaks(token: str, words: frozenset[str]) -> bool:
    """Whether a class or an id is made of such words, and of none with a meaning of its own."""
    parts = _PARTS.findall(_CAMEL.sub(" ", token).lower())
    return not words.isdisjoint(parts) and all(x in WORDS or x in BESIDE for x in parts)


def lines_of(html: str, piece: int = 1 << 16) -> list[Line]:
    """The page's lines; the parser is fed piece by piece."""
    events = _Events()
    for at in range(0, len(html), piece):
        events.feed(html[at : at + piece])
    events.close()
    events._flush()
    free = lambda x: 0 if x.out else max(0, len(x.text) - x.linked)
    total, held, blocks = sum(map(free, events.lines)), Counter(), Counter()
    for line in events.lines:
        held.update(dict.fromkeys(line.named, free(line)))
        blocks.update(n for n in line.named if free(line))
    written = [x for x in events.lines if free(x) and any(tag in ("article", "main") for _, tag in x.regions)]
    content = {n for n in held if blocks[n] > 1 and held[n] >= MOST * total and all(n in x.named for x in written)}
    content |= {n for n, fields in events.fields.items() if held[n] > FORM_TEXT * max(fields, 1)}
    content |= {n for x in written if x.heading == 1 for n in x.named if n not in events.fields}
    readers = None
    for line in events.lines:
        if readers and not (line.regions[: len(readers.regions)] == readers.regions and (not line.heading or line.heading > readers.heading)):
            readers = None
        if line.heading and not readers and _READERS.match(line.text):
            readers = line
        line.out = line.out or readers is not None or not content.issuperset(line.named)
    return events.lines


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters of text to tags, by line; none for lines that are left out or mostly links."""
    return np.array([0.0 if x.out or 2 * x.linked > len(x.text) else len(x.text) / max(x.tags, 1) for x in lines])


def smooth(values: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """A Gaussian average over neighbouring lines; at the ends over those there are."""
    reach = int(3 * width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    n = len(values)
    sums, mass = np.convolve(values, kernel)[reach : reach + n], np.convolve(np.ones(n), kernel)[reach : reach + n]
    return sums / mass


def content_region(lines: list[Line], chosen: np.ndarray) -> tuple[int, str] | None:
    """The element that holds the article of which the chosen lines are part; None is the whole page."""
    weight: dict[tuple[int, str], int] = {}
    path: dict[tuple[int, str], tuple] = {}
    total = 0
    for line, take in zip(lines, chosen, strict=True):
        if take:
            total += len(line.text)
            for d, r in enumerate(line.regions):
                weight[r] = weight.get(r, 0) + len(line.text)
                path[r] = line.regions[: d + 1]
    most = max((r for r, n in weight.items() if n >= SHARE * total), key=lambda r: len(path[r]), default=None)
    for tag in ("article", "main"):
        for r in path.get(most, ()):
            if r[1] == tag:
                return r
    region = max((r for r, n in weight.items() if n == total), key=lambda r: len(path[r]), default=None)
    for wider in (*path.get(region, ())[-2::-1], None):
        if any(x.out and x.text and region not in x.regions and (wider is None or wider in x.regions) for x in lines):
            break
        region = wider
    return region


def main_text(html: str) -> str:
    """The blocks of the content region in page order, joined by line feeds; empty where there is none."""
    lines = lines_of(html)
    if not lines:
        return ""
    own = ratios(lines)
    even = smooth(own)
    chosen = (even >= THRESHOLD * even.mean()) & (own > 0)
    if not chosen.any():
        return ""
    region = content_region(lines, chosen)
    kept = []
    within = [i for i, line in enumerate(lines) if chosen[i] and (not region or region in line.regions)]
    for i, line in enumerate(lines):
        if line.out or not line.text or (region and region not in line.regions):
            continue
        if 2 * line.linked > len(line.text) and not line.heading and not within[0] < i < within[-1] and not chosen[max(0, i - 1) : i + 2].any():
            continue  # a list of links before or after all text
        kept.append(line.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null html counts as empty and gives an empty text, as do pages without content. Broken markup is read as the parser does. Repeated rows
    and null ids stay; other columns are not looked at; an empty table gives an empty result. A page of any length is parsed piece by piece; its
    lines are held. One pass without a shuffle.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def each(batches) -> Iterator[tuple]:
        for i, url, html in rows(batches, "page_id", "url", "html"):
            yield i, url, main_text(html)

    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = held.mapInArrow(lambda b: batched(schema, each(b)), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
