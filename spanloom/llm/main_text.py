"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path (tag names, with classes). Each path has the mean text
length of its nodes and the mean number of punctuation marks; both are fused into one score, which falls with the share
of link text, and is smoothed over the nodes in page order, so that a short paragraph between long ones keeps up with
them. Paths that reach a threshold from the spread of the scores are content. The article or main element that holds nearly all of
their text, or else the least element that holds all of it, is the article; its remaining blocks (headings, lists,
emphasised words) and the headings right before it belong to the text. Links are judged by block: only blocks that are
nearly all links, and before or after the content, are left out.

Ratios can't tell an advert of one sentence from a heading. Elements that say what they are therefore never count: menus,
footers, forms and the like by tag name, role or by the words of their class and id. One that holds the larger part of
the page's text, as a wrapper "with-sidebar" does, is no such element unless the page names its article elsewhere.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg math object canvas audio video title"
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: A start tag of the key ends an open element of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements that an implied end does not reach beyond.
FENCES = {"table", "ul", "ol", "dl", "select", "td", "th", "article", "section", "div", "body"}
ENDS_PARAGRAPH = BLOCKS - {"br", "html", "head", "body", "option", "legend", "summary"}

# What a part of a page calls itself.
SIDE_TAGS = set("head nav footer aside form button select dialog menu".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments disqus "
    "respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget pagination pager search skip hidden".split()
)
MAIN_WORDS = set("article entry post story content main".split())
#: Elements that can be the article; a single paragraph can't.
CONTAINERS = set("html body main article section div center td".split())
NEVER_SIDE = {"html", "body", "article", "main", "p", "h1"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_TAIL = re.compile(r"[^<]+|<")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…¿¡«»“”]")

SMOOTHING = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
SPREAD = 0.8
COVER = 0.9
LINK_SHARE = 0.9
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _named(tag, attributes):
    """(path step, whether the element says that it is no article)."""
    if not attributes or attributes.isspace():
        return tag, tag in SIDE_TAGS
    step, side = tag, tag in SIDE_TAGS
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            if name == "class" and value:
                step = f"{tag}.{'.'.join(value.lower().split())}"
            if tag not in NEVER_SIDE and words & SIDE_WORDS and not (words & {"header"} and words & MAIN_WORDS):
                side = True
        elif tag in NEVER_SIDE:
            continue
        elif name == "role":
            side |= value.lower() in SIDE_ROLES
        elif name == "style":
            side |= "display:none" in value.lower().replace(" ", "")
        elif name == "hidden" or value.lower() == "true":
            side = True
    return step, side


class _Open:
    """The open elements of a page, innermost last. Every question about them is answered without going through them."""

    def __init__(self):
        self.tags, self.numbers = [], []
        self.places, self.fences = {}, []  # places of each tag, and of the elements an implied end does not pass

    def push(self, tag, number):
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in FENCES:
            self.fences.append(len(self.tags))
        self.tags.append(tag)
        self.numbers.append(number)

    def _cut(self, place):
        for tag in self.tags[place:]:
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
        del self.tags[place:], self.numbers[place:]

    def end(self, tag):
        """An end tag closes the innermost element of its name with all inside."""
        if self.places.get(tag):
            self._cut(self.places[tag][-1])

    def close(self, names):
        """An implied end closes the innermost element of one of the names, unless a fence stands inside of it."""
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=None)
        if place is not None and (not self.fences or self.fences[-1] <= place):
            self._cut(place)


class _Page:
    """Elements and text nodes of one page.

    Elements are numbered from 1 in page order, so an element and what it holds have the numbers ``e`` to ``last[e]``. A
    text node has the number of its element, its block and its path; what holds for all inside of an element (link,
    heading, paragraph) is noted at the element. Sizes of elements are sums from the last number to the first.
    """

    def __init__(self, source):
        self.texts, self.blocks, self.elements = [], [], []
        self.tags, self.parents, self.path_of, self.sides = [""], [0], [0], [False]
        self.in_link, self.in_heading, self.in_title, self.in_paragraph = [False], [False], [False], [False]
        paths = {}
        opened = _Open()
        block = 0
        tags_end = source.rfind(">")
        for found in _TOKEN.finditer(source):
            if found.start() > tags_end:  # no tag can follow, whatever begins one
                tail = source[found.start() :].split("<!--", 1)[0]
                parts = _TAIL.findall(tail)
                self._add(parts, block, opened)
                break
            raw, end, tag, attributes, end2, tag2, attributes2, text = found.groups()
            if text is not None:
                self._add([text], block, opened)
                continue
            if tag is None:
                tag, end, attributes = tag2, end2, attributes2
            if tag is None:  # a comment, a declaration or raw text
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                block += 1
            if end:
                opened.end(tag)
                continue
            if tag in ENDS_PARAGRAPH:
                opened.close({"p"})
            if tag in ENDS:
                opened.close(ENDS[tag])
            if tag in VOID or attributes.endswith("/"):
                continue
            step, side = _named(tag, attributes)
            parent = opened.numbers[-1] if opened.numbers else 0
            opened.push(tag, len(self.tags))
            self.tags.append(tag)
            self.parents.append(parent)
            self.sides.append(side)
            self.path_of.append(paths.setdefault((self.path_of[parent], step), len(paths) + 1))
            self.in_link.append(self.in_link[parent] or tag == "a")
            self.in_heading.append(self.in_heading[parent] or tag in HEADINGS)
            self.in_title.append(self.in_title[parent] or tag == "h1")
            self.in_paragraph.append(self.in_paragraph[parent] or step.startswith("p"))
        self.last = np.arange(len(self.tags))
        for e in range(len(self.tags) - 1, 0, -1):
            self.last[self.parents[e]] = max(self.last[self.parents[e]], self.last[e])
        self._leave_out()

    def _add(self, texts, block, opened):
        self.texts += texts
        self.blocks += [block] * len(texts)
        self.elements += [opened.numbers[-1] if opened.numbers else 0] * len(texts)

    def sums(self, values):
        """Per element the sum of ``values`` (one per text node) over all text inside of it."""
        out = np.bincount(self.elements, values, minlength=len(self.tags)) if self.elements else np.zeros(len(self.tags))
        out = out.tolist()
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return np.array(out)

    def within(self, element):
        """Whether each text node lies in the element."""
        at = np.array(self.elements, dtype=np.int64)
        return (at >= element) & (at <= self.last[element])

    def _leave_out(self):
        """Drops the text nodes inside of side elements, and blanks before the first one that stays."""
        linked = [self.in_link[e] for e in self.elements]
        size = np.array([0 if a else len(t) - t.count(" ") for t, a in zip(self.texts, linked)], dtype=float)
        held = self.sums(size)
        large = {e for e, side in enumerate(self.sides) if side and held[e] > 0 and 2 * held[e] > size.sum()}
        small = [False] * len(self.tags)  # inside a side element that is not large
        for e in range(1, len(self.tags)):
            small[e] = small[self.parents[e]] or (self.sides[e] and e not in large)
        released = set()
        named = np.array([e for e, tag in enumerate(self.tags) if tag in ("article", "main")], dtype=np.int64)
        if large and len(named):
            free = self.sums(np.where([small[e] for e in self.elements], 0.0, size))
        for e in large:
            elsewhere = 0.0
            if len(named):
                # What an article holds outside of e: all, nothing if it lies in e, all but e if e lies in it.
                around = (named <= e) & (self.last[named] >= e)
                inside = (named > e) & (named <= self.last[e])
                elsewhere = float(np.where(inside, 0.0, free[named] - np.where(around, free[e], 0.0)).max())
            if 4 * elsewhere < held[e]:
                released.add(e)
        gone = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            gone[e] = gone[self.parents[e]] or (self.sides[e] and e not in released)
        keep = [i for i, e in enumerate(self.elements) if not gone[e]]
        first = next((k for k, i in enumerate(keep) if not self.texts[i].isspace()), len(keep))
        for name in ("texts", "blocks", "elements"):
            column = getattr(self, name)
            setattr(self, name, [column[i] for i in keep[first:]])
        self.linked = [self.in_link[e] for e in self.elements]
        self.paths = [self.path_of[e] for e in self.elements]


def path_scores(page):
    """Fused and smoothed score per tag path, the share of link text per path, and the paths' text lengths."""
    clean = [html.unescape(t) if "&" in t else t for t in page.texts]
    length = np.array([len(t) - t.count(" ") for t in clean], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in clean], dtype=float)
    _, path = np.unique(page.paths, return_inverse=True)
    count = np.bincount(path)
    total = np.bincount(path, length)
    ratio, punctuation = total / count, np.bincount(path, marks) / count
    links = np.bincount(path, length * np.array(page.linked)) / np.maximum(total, 1)
    fused = ratio * (1 + punctuation) * (1 - links)
    series = fused[path]
    padded = np.pad(series, 2, mode="edge")
    smooth = np.convolve(padded, SMOOTHING / SMOOTHING.sum(), mode="valid")
    score = np.maximum(fused, np.bincount(path, smooth) / count) * (links < 1)
    return clean, length, path, score, links


def _article(page, chosen, length):
    """The article or main element with nearly all text of the content paths, or the least container with all of it."""
    inside, nodes = page.sums(np.where(chosen, length, 0.0)), page.sums(chosen.astype(float))
    wanted = COVER * length[chosen].sum()
    for tag in ("article", "main"):
        all_of = np.array([e for e, t in enumerate(page.tags) if t == tag], dtype=np.int64)
        named = all_of[inside[all_of] >= wanted]
        if len(named):
            best = int(named.max())
            others = all_of[(inside[all_of] < wanted) & (nodes[all_of] > 0)]
            if ((others > best) & (others <= page.last[best])).all():
                return best
    full = np.flatnonzero(nodes == chosen.sum())
    return max((int(e) for e in full if page.tags[e] in CONTAINERS), default=None)


def _headings_before(page, article, first):
    """Text nodes of the headings right before the article, or of the last main heading before one that has none."""
    out, i = [], first - 1
    while i >= 0 and (page.in_heading[page.elements[i]] or page.texts[i].isspace()):
        out += [i] if page.in_heading[page.elements[i]] else []
        i -= 1
    within = np.flatnonzero(page.within(article))
    if page.tags[article] not in ("article", "main") and not any(page.in_title[page.elements[k]] for k in within):
        titles = [
            i for i in range(first)
            if page.in_title[page.elements[i]] and not page.linked[i] and not page.texts[i].isspace()
        ]
        if titles:
            out += [i for i in range(first) if page.blocks[i] == page.blocks[titles[-1]]]
    return set(out)


def main_text(source):
    """The main text of one page: its blocks in page order, joined by one blank."""
    if not source:
        return ""
    page = _Page(source)
    if not page.texts:
        return ""
    clean, length, path, score, _ = path_scores(page)
    content = (score > 0) & (score >= SPREAD * score.std())
    chosen = content[path] & (length > 0)
    if not chosen.any():
        return ""
    article = _article(page, chosen, length)
    within = list(range(len(clean))) if article is None else np.flatnonzero(page.within(article)).tolist()
    before = _headings_before(page, article, within[0]) if article is not None else set()
    places = np.flatnonzero(chosen)
    # All of an article element is its flow; elsewhere it goes from the first to the last content.
    flow = (0, len(clean)) if article is not None and page.tags[article] == "article" else (places[0], places[-1])
    total, links = {}, {}
    for i in within:
        total[page.blocks[i]] = total.get(page.blocks[i], 0) + length[i]
        links[page.blocks[i]] = links.get(page.blocks[i], 0) + length[i] * page.linked[i]
    out, last = [], None
    for i in sorted({*within, *before}):
        block = page.blocks[i]
        if not (flow[0] <= i <= flow[1] or i in before or content[path[i]] or page.in_paragraph[page.elements[i]]):
            heading = page.in_heading[page.elements[i]]
            if not heading and total[block] and links[block] >= LINK_SHARE * total[block]:
                continue
        if block == last:
            out[-1] += clean[i]
        else:
            out.append(clean[i])
            last = block
    return " ".join(x for x in (" ".join(t.split()) for t in out) if x)


def _extracted(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    text is empty for a null or empty page and for one without content; n_chars counts its code points. Character
    references are decoded, white space inside a block becomes one blank, and blocks are joined by one blank. Markup that
    is broken is read as far as it goes. Repeated rows are returned as often as they occur, further columns are ignored,
    an empty table gives an empty result.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).toDF("page_id", "url", "html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
