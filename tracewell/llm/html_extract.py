"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block by link density, length and stop-word
density; blocks inside containers that never hold the article (navigation, footers, sidebars, adverts, notices,
forms, reader comments, scripts) are decided bad. A marked article (``article``, ``main``) is a prior: in it, blocks that
are not full of links count as good; outside it, only long blocks with many stop words do. The mark is ignored if the
article has less text than the good blocks outside it. Pass two gives each ambiguous block the label of its nearest
decided neighbours. Good blocks are joined in page order.

Inside the article formulae (without their annotations) and buttons in running text are text; of a header in the
article its headings and paragraphs stay.

Defined results: null or empty html gives an empty text; a page without any good block gives an empty text; broken
markup (unclosed tags, cut files, stray ends) never fails; each row is handled alone, repeated rows stay; a short block
as far from a good as from a bad neighbour is bad; an empty table gives no rows; a very long page takes time in
proportion to its length, however deep its elements; other columns are not read, whatever their names. White space
includes the no-break space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sub_batches

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bis da das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns unter von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur tu un une vous y à été
    al como con cuando de del desde donde el ella ellos en entre era es esa ese esta este ha hasta hay la las le les lo los más me mi muy no nos o para pero por porque que se si sin sobre son su sus también tu un una y ya yo""".split()
)
#: HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose blocks are never part of the article.
BAD_TAGS = frozenset("nav footer aside form button select menu dialog head header fieldset".split())
#: Words of class, id and role that mark such containers.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations footer masthead topbar toolbar widget widgets pagination pager complementary contentinfo advertising".split()
)
NEGATED = frozenset("has with no without is not".split())

LISTS = frozenset(("ul", "ol", "menu", "div", "article", "main", "section"))
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.DOTALL)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")

#: Parameters of pass one.
LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.30


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool  # in a container that never holds the article
    article: bool  # in a marked article
    heading: bool
    item: bool  # a list item


def bad_container(attrs: str) -> bool:
    """Whether class, id or role names a container without article text, or the element is hidden."""
    for name, a, b, c in ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if words and words[0] not in NEGATED and not BAD_WORDS.isdisjoint(words):
                    return True
    return False


#: Why content is bad: nothing does, a header in the article alone does, something else does.
FINE, HEADER, BAD = 0, 1, 2


class Open:
    """The open elements of a page: tag, why its content is bad, whether its content is the article's."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.count: Counter[str] = Counter()

    def top(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (FINE, False)

    def push(self, tag: str, why: int, article: bool) -> None:
        self.stack.append((tag, why, article))
        self.count[tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.count[tag] -= 1
        return tag

    def any(self, tags: frozenset[str]) -> bool:
        return any(self.count[t] for t in tags)

    def close(self, tag: str) -> None:
        """The end tag of ``tag``: all that stands in it closes too."""
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def implied(self, tag: str, keep: frozenset[str]) -> None:
        """Close the innermost ``tag`` unless an element of ``keep`` or a link stands inside it."""
        if not self.count[tag] or self.count["a"]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in keep:
                return


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page in order."""
    out: list[Block] = []
    inside = Open()
    parts: list[str] = []
    link_parts: list[str] = []

    def close() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                why, article = inside.top()
                heading = inside.any(HEADINGS)
                bad = why == BAD or why == HEADER and not heading and not inside.count["p"]
                out.append(Block(text, len(" ".join("".join(link_parts).split())), bad, article, heading, inside.count["li"] > 0))
            parts.clear()
            link_parts.clear()

    at = 0
    while True:
        m = TOKEN.search(html, at)
        if (raw := html[at : m.start() if m else len(html)]) :
            text = unescape(raw)
            parts.append(text)
            if inside.count["a"]:
                link_parts.append(text)
        if not m:
            break
        at = m.end()
        if tag := m["tag"]:
            tag = tag.lower()
            if tag in RAW:
                if not m["attrs"].rstrip().endswith("/"):
                    end = RAW_END[tag].search(html, at)
                    at = end.end() if end else len(html)
                continue
            inline = tag == "button" and inside.count["p"] > 0  # a button in running text
            if tag in BLOCK and not inline:
                close()
            if tag in VOID:
                continue
            if tag == "p" or tag in HEADINGS:  # an open paragraph ends here
                inside.implied("p", BLOCK - {"p"})
            elif tag == "li":
                inside.implied("li", LISTS)
            why, article = inside.top()
            if tag in ("article", "main"):
                article = article or why == FINE
            elif tag not in ("html", "body") and why != BAD and not inline:
                if tag == "header" and article and not bad_container(m["attrs"]):
                    why = HEADER
                elif tag in BAD_TAGS or bad_container(m["attrs"]):
                    why = BAD
            inside.push(tag, why, article)
        elif tag := m["end"]:
            tag = tag.lower()
            if tag in BLOCK and not (tag == "button" and inside.count["p"]):
                close()
            inside.close(tag)
    close()
    return out


def first_pass(b: Block) -> str:
    """good, bad, near (rather good) or short, without regard to a marked article."""
    n = len(b.text)
    density = b.link_chars / n
    if b.bad or b.item and density > 0.8 or density > LINK_DENSITY:
        return "bad"
    if n < SHORT:
        return "bad" if b.link_chars and not b.heading else "short"
    words = LETTERS.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return ("good" if n > LONG else "near") if stop >= STOP_HIGH else "near" if stop >= STOP_LOW or not b.link_chars else "bad"


def with_prior(b: Block, label: str) -> str:
    """The label of a block of a page whose marked article counts."""
    if b.bad or b.item and b.link_chars > 0.8 * len(b.text):
        return "bad"
    if not b.article:
        return "good" if label == "good" else "bad"
    return "good" if b.link_chars <= LINK_DENSITY * len(b.text) or b.heading else "short"


def classify(found: list[Block]) -> list[bool]:
    """Good or not for each block, by the two passes."""
    labels = [first_pass(b) for b in found]
    inside = sum(len(b.text) for b in found if b.article and not b.bad)
    if inside and inside >= sum(len(b.text) for b, x in zip(found, labels, strict=True) if x == "good" and not b.article):
        labels = [with_prior(b, x) for b, x in zip(found, labels, strict=True)]
    decided = [k for k, x in enumerate(labels) if x in ("good", "bad")]
    if not decided:  # nothing to inherit from: whole paragraphs stand for themselves
        return [x == "near" for x in labels] if "near" in labels else [True] * len(labels)
    before: list[int | None] = []
    last = None
    for k, x in enumerate(labels):
        before.append(last)
        last = k if x in ("good", "bad") else last
    after: list[int | None] = [None] * len(labels)
    last = None
    for k in range(len(labels) - 1, -1, -1):
        after[k] = last
        last = k if labels[k] in ("good", "bad") else last
    good = []
    for k, x in enumerate(labels):
        if x in ("good", "bad"):
            good.append(x == "good")
            continue
        p, q = before[k], after[k]
        if found[k].heading and q is not None:  # a heading belongs to what follows
            good.append(labels[q] == "good")
            continue
        near = [labels[j] == "good" for j in (p, q) if j is not None]
        if len(near) == 1 or near[0] == near[1]:
            good.append(near[0] or x == "near" and "good" not in labels)
        elif x == "near":
            good.append(True)
        else:
            good.append(near[0] if k - p < q - k else near[1] if q - k < k - p else False)
    return good


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    return " ".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[2]):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(page_id, url, html).mapInArrow(run, "page_id long, url string, text string, n_chars long")
