"""HTML main text by two passes of block rules.

Blocks are runs of text between block-level tags. The first pass decides each one by its link density, its length and
the density of stop words: `good`, `bad`, or `short` where that is not enough. The second pass gives short blocks the
label of their nearest decided neighbours (both must agree, or the block stands nearer to the good one, or is a heading
before good text); a block that speaks against itself (no sentence, or mostly links within an article) needs good text
on both sides. Stop words speak for a block, their lack does not speak against sentences: where a page has few of
the known ones, or a block is in sentences or mostly in another script, link density, length and neighbours decide.
Blocks in page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role or
class) are bad beforehand and do not vote; a form around most of the page's long text is none.

A page is read once from left to right, in time that grows with its length whatever it holds.

Defined cases: null or empty html gives an empty text; text outside any element counts; unclosed and stray tags are
tolerated; without any good block, short blocks of the article (or, without one, of the body) stay; scripts, styles,
comments and other raw text never count; a tag that the page breaks off in ends it; an attribute's quote that is never
closed ends at the next `>`; rows are independent, repeated ones too; an empty table gives an empty one; other columns
are carried along except those that an output replaces.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    one you were her all she there would their we him been has when who will more no if out so
    der die und von den das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux mais nous
    comme leur elle deux ses ont était sans cette
    el que y los del las por con una su para lo como más pero sus al fue este ha entre cuando muy sin sobre también me
    hasta hay donde""".split()
)
#: Elements whose content is not text, elements of page furniture, and block-level elements (public HTML names).
RAW = "script style textarea title iframe xmp".split()
#: Elements that are left out as a whole if they are closed; else only their tag is.
WHOLE = "noscript template svg math object select datalist canvas".split()
#: What a head may hold; another tag ends it, closed or not.
HEAD = frozenset("base basefont bgsound link meta noframes".split() + RAW + WHOLE)
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role (each name is cut at - and _): those that mark furniture, beginnings of such words, those
#: that do so only if all names beside them are of these kinds, those of reader comments, and those that may stand beside.
MARK = frozenset("ad ads banner breadcrumb breadcrumbs contentinfo cookie cookies dialog disqus footer header masthead modal newsletter popup sidebar subscribe toolbar widget widgets complementary".split())
MARK_STEMS = ("advert", "menu", "nav", "promo", "sponsor")
WEAK = frozenset("comment comments notice notices related search share sharing social".split())
COMMENT = frozenset("comment comments commentlist commenter commenters commentform responses respond replies".split())
OF_COMMENT = frozenset("user users reader readers body text content author meta thread threads wrap wrapper container inner outer children reply entry holder title count header".split())
BESIDE = frozenset("site main global top bottom left right primary secondary mobile area bar box block list link links item items button buttons icon icons form consent posts section".split())
#: Marks that an article's own heading may carry.
OWN = frozenset(("header", "masthead"))
PARTS = re.compile(r"[_-]+")
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW + WHOLE}
ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
#: Letters beyond the Latin script, of which the stop words say nothing.
BEYOND = re.compile(r"[^\W\d_\u0000-\u024f]")
#: Ends of sentences in several scripts.
SENTENCE = re.compile(r"[.!?\u2026](?:\s|$|[\"'\u00bb\u201d])|[\u3002\uff01\uff1f\u0964\u06d4\u061f\u1362]")
#: Thresholds of the first pass.
LINK_SHARE, LONG, SHORT, STOP_HIGH, STOP_LOW = 0.5, 140, 60, 0.12, 0.05
#: From this share of links on a block of an article is nothing but links.
WHOLLY = 0.9


class Element:
    """An open element: its name, whether it marks furniture, and the nearest one around it that did when it was opened."""

    __slots__ = ("tag", "marked", "around", "inside")

    def __init__(self, tag: str, marked: bool, around: Element | None) -> None:
        self.tag, self.marked, self.around = tag, marked, around
        self.inside = 0  # 1 within furniture, 2 within forms alone


class Block:
    __slots__ = ("text", "linked", "heading", "around", "article", "furniture", "label")

    def __init__(self, text: str, linked: int, heading: bool, around: Element | None, article: bool) -> None:
        self.text, self.linked, self.heading, self.around, self.article = text, linked, heading, around, article
        self.furniture, self.label = False, ""


def marks(value: str) -> bool:
    """Whether a class, id or role names furniture: one name of marks and words that stand beside them, or all names of these kinds and a weak mark among them."""
    all_known = some_weak = False
    for i, name in enumerate(value.lower().split()):
        known = of_comment = True
        mark = comment = weak = False
        for word in PARTS.split(name):
            is_mark = word in MARK or (word.startswith(MARK_STEMS) and word.isascii() and word.isalnum())
            is_weak = word in WEAK
            mark |= is_mark
            weak |= is_weak
            comment |= word in COMMENT
            plain = is_mark or is_weak or word in BESIDE or (word.isascii() and word.isdigit())
            known &= plain
            of_comment &= plain or word in COMMENT or word in OF_COMMENT
        if (known and mark) or (of_comment and comment):
            return True
        all_known = known and (all_known or not i)
        some_weak |= weak
    return all_known and some_weak


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of tags; no name for what is left out whole. The last may break off."""
    at, size = 0, len(page)
    dead: set[int] = set()  # quotes from which no tag's end is reached
    unclosed: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", False, ""
            continue
        m = TAG.match(page, start)
        if not m:
            if page[start + 1 : start + 2] not in ("!", "?", "/"):
                at = start + 1
                continue
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            yield start, at, "", False, ""
            continue
        name, closes = m[1].lower(), page[start + 1] == "/"
        end, met = m.end(), []
        while (stop := STOP.search(page, end)) and stop[0] != ">":
            met.append(stop.start())
            end = page.find(stop[0], stop.end()) + 1 if stop.start() not in dead else 0
            if not end:
                stop = None
                break
        if stop:
            end = stop.end()
        else:
            dead.update(met)
            end = page.find(">", m.end()) + 1
        if not end:
            yield start, size, "", False, ""
            return
        attrs = page[m.end() : end - 1]
        at = end
        if not closes and name in ENDS and not (name in ("svg", "math") and attrs.endswith("/")):
            close = None if name in unclosed else ENDS[name].search(page, end)
            if close:
                at = close.end()
                name = ""
            elif name in RAW:
                at, name = size, ""
            else:
                unclosed.add(name)
        elif name in ENDS:
            name = ""
        yield start, at, name, closes, attrs


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[Element] = []
    made: list[Element] = []  # all that were marked, in the order of their tags
    open_tags: Counter = Counter()
    held: list[Element] = []  # open marked ones that a main or an article inside makes a wrapper
    told = 0  # how many of these are among the wrappers
    wrappers: list[Element] = []
    outside = False
    links = furniture = article = 0
    heading = ""
    in_head = False

    def clean(raw: str) -> str:
        return SPACE.sub(" ", html.unescape(raw)).strip()

    def end() -> None:
        text = clean("".join(p for p, _ in parts))
        if text:
            linked = sum(len(clean("".join(p for p, _ in run))) for link, run in itertools.groupby(parts, key=lambda p: p[1]) if link)
            out.append(Block(text, linked, bool(heading), chain(), article > 0))
        parts.clear()

    def chain() -> Element | None:
        return None if not stack else stack[-1] if stack[-1].marked else stack[-1].around

    def leave(e: Element) -> None:
        nonlocal furniture, article, told
        furniture -= e.marked
        article -= e.tag in ("article", "main")
        open_tags[e.tag] -= 1
        if held and held[-1] is e:
            held.pop()
            told = min(told, len(held))

    def text(raw: str) -> None:
        parts.append((raw, links > 0))

    at = 0
    for start, after, name, closes, attrs in tokens(page):
        if start > at:
            text(page[at:start])
        at = after
        if not name:
            continue
        if name == "head":
            if closes and in_head:
                parts.clear()  # stray text of a closed head
            end()
            in_head = not closes
            continue
        if in_head:
            if closes and name != "html" or name in HEAD:
                continue
            in_head = False
            end()
        if name in INLINE:
            if name == "a":
                links = 0 if closes else 1
            elif name == "br":
                text(" ")
            if name not in ("span", "label", "a"):
                continue
            if name != "span":
                continue
        else:
            end()
        if closes:
            while open_tags[name]:
                leave(e := stack.pop())
                if e.tag == name:
                    break
            if name == heading:
                heading = ""
            if name not in INLINE:
                links = 0
        elif name not in VOID and not attrs.endswith("/"):
            marked = name in FURNITURE or name not in ("html", "body", "article", "main") and any(marks(v) and not (article and v.strip().lower() in OWN) for v in map("".join, ATTRS.findall(attrs)))
            if name == "header" and article:
                marked = False  # the article's own heading
            if marked and name in INLINE:
                end()
            if name in ("p", "li", "td", "th", "tr", "option", "dt", "dd") and stack and stack[-1].tag == name:
                leave(stack.pop())
            if name in ("article", "main") and not article:
                if name == "main":
                    for e in held:
                        e.marked = False
                    furniture -= len(held)
                    held.clear()
                    told = 0
                else:
                    wrappers += held[told:]
                    told = len(held)
                outside |= not furniture
            stack.append(e := Element(name, marked, chain()))
            open_tags[name] += 1
            furniture += marked
            if marked:
                made.append(e)
                if name == "form" or name not in FURNITURE:
                    held.append(e)
            article += name in ("article", "main")
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = name
    if at < len(page):
        text(page[at:])
    end()
    if not outside:  # the page's article is in what looked like furniture
        for e in wrappers:
            e.marked = False
    for e in made:  # an element's surroundings come before it
        inside = e.around.inside if e.around else 0
        e.inside = inside if not e.marked or inside == 1 else 2 if e.tag == "form" else 1
    room = [b for b in out if len(b.text) >= LONG and b.linked <= LINK_SHARE * len(b.text)]
    within = sum(len(b.text) for b in room if b.around and b.around.inside == 2)
    around_all = within > sum(len(b.text) for b in room if not b.around or not b.around.inside)  # a form around the page
    for b in out:
        b.furniture = bool(b.around) and b.around.inside in ((1,) if around_all else (1, 2))
    return out


def classify(found: list[Block]) -> None:
    """First pass: rules on one block; second pass: neighbours decide the rest."""
    shares = []
    for b in found:
        words = b.text.lower().split()
        shares.append(sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words))
    body = [(len(b.text), s) for b, s in zip(found, shares, strict=True) if not b.furniture and b.linked <= LINK_SHARE * len(b.text)]
    foreign = sum(n * s for n, s in body) < STOP_HIGH * sum(n for n, _ in body)
    inside = any(b.article for b in found if not b.furniture)
    for b, stops in zip(found, shares, strict=True):
        n = len(b.text)
        if b.furniture or b.linked > LINK_SHARE * n:
            b.label = "doubt" if not b.furniture and b.article and b.linked < WHOLLY * n and SENTENCE.search(b.text) else "bad"
        elif n < SHORT or b.heading:
            b.label = "short"
        elif stops >= STOP_HIGH and n >= LONG:
            b.label = "good"
        elif stops >= STOP_LOW or b.article:
            b.label = "short"
        elif foreign or 2 * len(BEYOND.findall(b.text)) > n:
            b.label = "good" if n >= LONG and not inside else "short"
        else:
            b.label = "short" if SENTENCE.search(b.text) else "doubt"
    flow = [b for b in found if not b.furniture]
    decided = [i for i, b in enumerate(flow) if b.label in ("good", "bad")]
    labels = {i: flow[i].label for i in decided}
    any_good = "good" in labels.values()
    has_article = any(b.article for b in flow)
    k = 0
    for i, b in enumerate(flow):
        if b.label in ("good", "bad"):
            k += 1
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if b.label == "doubt":
            b.label = "good" if before is not None and after is not None and labels[before] == labels[after] == "good" else "bad"
            continue
        if not any_good:
            b.label = "good" if b.article or not has_article else "bad"
            continue
        near = [labels[j] for j in (before, after) if j is not None]
        if len(set(near)) == 1:
            b.label = near[0]
        elif b.heading or b.article:
            b.label = "good"
        else:
            b.label = labels[before] if i - before <= after - i else labels[after]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text and n_chars, its number of code points."""
    pages = without(pages, out, "n_chars")
    names = pages.columns
    at = [n.lower() for n in names].index(html_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [main_text(h.as_py()) for h in rb.column(at)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, out, "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(rows, f"{fields}, `{out}` string, n_chars long")
