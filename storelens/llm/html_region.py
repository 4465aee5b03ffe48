"""Operator 2: main text of a page by a maximum-scoring run of tokens.

A page is read once into words, tags and comments. A word scores positive, a tag
negative; the run of tokens with the largest sum is the content, found by one
linear scan. Weights come from labelled pages: pages that mark their own
content with an element of CONTENT. Over those, each kind of element (its name
with its class) gets the share of its words that lie in the content; a tag
costs the more, the more of its kind stand outside the content, so a run does
not cross menus or footers to gain a few words. Words whose element, or one
around it, is of a kind found outside count against the run and are not text.
Dropped elements within marked content score nothing, so the run goes on past
them and only their own words are left out.
Kinds that no labelled page shows take the weights of BOILERPLATE names.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space. Null and empty
pages, and pages without a word, give the empty text. Broken markup (elements
left open, closed twice or cut off at the end) is read as far as it goes. Time
grows with a page's tokens, not with their depth. Repeated rows give equal texts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import batches, kept_names

TRAIN_PAGES = 4000
KINDS = 2000

# Fixed names of the markup language.
CONTENT = frozenset({"article", "main"})
RAW = frozenset({"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "noframes", "math"})
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"})
# Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset({"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"})
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "label", "dialog", "head"})
BOILERPLATE_CLASS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|repl(?:y|ies)|share|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
# Words that name the shape or place of an element; with one of the above they make a name of boilerplate.
SHAPES = frozenset("area articles bar block body bottom box button buttons col column container content cta form group header icon icons inline inner item items left link links list main modal outer overlay panel post posts right row section signup slot small thread title top unit wide widget wrap wrapper".split())
# Elements whose ids are anchors of their own text.
ANCHORED = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p"})

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:[\"'][^>]*)?(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Costs of tags whose kind was seen in content and of those that never were.
LEAST_COST, MOST_COST = 0.05, 60.0


def tokens(page: str):
    """("text", text, None), ("open", name, kind) and ("close", name, None) in page order.

    A kind is the element's name and, in order, its classes, ids (after a #) and
    role. What stands inside RAW elements is passed over.
    """
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], None
            return
        if found.start() > at:
            yield "text", page[at : found.start()], None
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            yield "close", name, None
            continue
        marks = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(found.group(3))] if found.group(3).strip() else []
        kind = ".".join([name, *("#" * (k == "id") + " ".join(v.lower().split()) if k != "hidden" else "hidden" for k, v in marks)])
        if name in RAW and not found.group(3).endswith("/"):
            end = RAW_END[name].search(page, at)
            if end is None and name not in ("title", "textarea"):
                return
            if end is not None:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            continue
        yield "open", name, kind


class Element:
    """An element's place: its number in page order, the element around it, its kind, and how many elements
    that are not INLINE it stands in, itself included."""

    __slots__ = ("number", "around", "kind", "name", "blocks")

    def __init__(self, number: int, around: Element | None, kind: str, name: str):
        self.number, self.around, self.kind, self.name = number, around, kind, name
        self.blocks = (around.blocks if around else 0) + (name not in INLINE)


def placed(page: str):
    """Each token with the element around it, which for a tag is its own: (what, name or text, element or None).

    Elements left open end with the element around them. Open elements are found by name, so a page costs time in
    proportion to its tokens, however deep they are nested.
    """
    stack: list[Element] = []
    at_name: dict[str, list[int]] = {}
    number = 0

    def shut(last: int) -> None:
        while len(stack) > last:
            at_name[stack.pop().name].pop()

    for what, value, kind in tokens(page):
        if what == "open":
            if value in ENDS_PARAGRAPH and at_name.get("p"):
                last = at_name["p"][-1]
                if stack[-1].blocks == stack[last].blocks:
                    shut(last)
            elif value == "li" and stack and stack[-1].name == "li":
                shut(len(stack) - 1)
            here = Element(number, stack[-1] if stack else None, kind, value)
            number += 1
            if value not in VOID:
                at_name.setdefault(value, []).append(len(stack))
                stack.append(here)
            yield what, value, here
        else:
            yield what, value, stack[-1] if stack else None
            if what == "close" and at_name.get(value):
                shut(at_name[value][-1])


def name_of(kind: str) -> str:
    return kind.partition(".")[0]


def odd_kind(kind: str) -> bool:
    """Whether an element's name or class says that it is not content."""
    name, _, marks = kind.partition(".")
    return name in BOILERPLATE or (bool(marks) and (BOILERPLATE_CLASS.search(marks.replace(".", " ").replace("#", " ")) is not None or "hidden" in marks.split(".")))


def odd_inside(kind: str) -> bool:
    """odd_kind() within marked content, where a name counts only if all its words are of boilerplate or SHAPES.

    Ids of headings and paragraphs say nothing there.
    """
    if not odd_kind(kind):
        return False
    name, *marks = kind.split(".")
    if name in BOILERPLATE or "hidden" in marks:
        return True
    names = [x for m in marks if not (m.startswith("#") and name in ANCHORED) for x in m.replace("#", " ").split()]
    return any(BOILERPLATE_CLASS.search(x) and all(w in SHAPES or w.isdigit() or BOILERPLATE_CLASS.search(w) for w in re.split("[_-]+", x) if w) for x in names)


def count_page(page: str, counts: Counter) -> None:
    """Adds the words and tags of each kind, inside and outside the content, of a page that marks its content."""
    found = list(placed(page))
    # By number of element: it, whether it is or lies in content, whether none around it is of its kind, words inside and outside.
    elements: list[Element] = []
    content: list[bool] = []
    words: list[list[int]] = []
    for what, value, here in found:
        if here is not None and here.number == len(elements):
            elements.append(here)
            content.append(name_of(here.kind) in CONTENT or (here.around is not None and content[here.around.number]))
            words.append([0, 0])
    if not any(content):
        return
    for what, value, here in found:
        if what == "text":
            if here is not None:
                words[here.number][content[here.number]] += len(value.split())
        else:
            around = here.around if here is not None else None
            counts[here.kind if here is not None else value, "tag", around is not None and content[around.number]] += 1
    # Words of an element are those of all within it, once for each kind: numbers grow inwards, so sums go up in one pass.
    for here in reversed(elements):
        if here.around is not None:
            for inside in (0, 1):
                words[here.around.number][inside] += words[here.number][inside]
    for here in outermost(elements):
        for inside in (False, True):
            if words[here.number][inside]:
                counts[here.kind, "word", inside] += words[here.number][inside]


def outermost(elements: list[Element]):
    """The elements that lie in none of their own kind; `elements` are in page order."""
    open_now: list[Element] = []
    kinds: Counter = Counter()
    for here in elements:
        while open_now and open_now[-1] is not here.around:
            kinds[open_now.pop().kind] -= 1
        if not kinds[here.kind]:
            yield here
        open_now.append(here)
        kinds[here.kind] += 1


class Weights:
    """Costs of tags and the kinds of elements whose words are not content."""

    def __init__(self, rows: list[tuple[str, str, bool, int]]):
        counts = Counter()
        for kind, what, inside, n in rows:
            counts[kind, what, inside] += n
        self.cost: dict[str, float] = {}
        self.outside: dict[str, bool] = {}
        self.foreign: dict[str, bool] = {}
        for kind in {k for k, _, _ in counts}:
            inside, outside = counts[kind, "tag", True], counts[kind, "tag", False]
            # Log odds of standing outside, scaled by how many words such an element holds.
            odds = math.log((outside + 0.5) / (inside + 0.5))
            held = (counts[kind, "word", True] + counts[kind, "word", False]) / max(1, inside + outside)
            self.cost[kind] = min(MOST_COST, max(LEAST_COST, odds * (1 + held)))
            words_in, words_out = counts[kind, "word", True], counts[kind, "word", False]
            self.outside[kind] = words_in == 0 and words_out > 0
            # A class or id whose words stand outside nine times in ten is no content within an article either.
            self.foreign[kind] = "." in kind and name_of(kind) not in INLINE and name_of(kind) not in ANCHORED and words_out > 9 * words_in

    def of_tag(self, kind: str) -> float:
        known = self.cost.get(kind)
        if known is not None:
            return known
        if name_of(kind) in INLINE:
            return LEAST_COST
        if odd_kind(kind) or name_of(kind) in CONTENT:
            return MOST_COST / 6
        # A heading's few words are worth its tags.
        return LEAST_COST if name_of(kind) in ANCHORED else 0.5

    def drops(self, kind: str) -> bool:
        if name_of(kind) in CONTENT or name_of(kind) in ("html", "body"):
            return False
        return odd_kind(kind) or (self.outside.get(kind, False) and name_of(kind) not in ("p", "div", "section", "span", "h1", "h2", "h3", "b", "i", "em", "strong"))

    def judge(self, kind: str, around: tuple[bool, bool]) -> tuple[bool, bool]:
        """Whether words in an element of a kind are dropped, and whether it is or lies in marked content; from the
        same of the element around it.

        Within marked content only names and classes count, those learned to be foreign to it included: a plain link
        there is text, whatever links are elsewhere.
        """
        odd, marked = around
        if name_of(kind) in CONTENT:
            return False, True
        return odd or (odd_inside(kind) or self.foreign.get(kind, False) if marked else self.drops(kind)), marked


def region(page: str, weights: Weights) -> list[tuple[str, str, bool]]:
    """(what, name or text, is content) of the tokens in the best run; a linear scan."""
    found = []
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    judged: list[tuple[bool, bool]] = []
    for i, (what, value, here) in enumerate(placed(page)):
        if here is not None and here.number == len(judged):
            judged.append(weights.judge(here.kind, judged[here.around.number] if here.around else (False, False)))
        odd, marked = judged[here.number] if here is not None else (False, False)
        inside = marked and name_of(here.kind) not in CONTENT
        found.append((what, value, not odd))
        if odd and inside:
            score = 0.0
        elif what == "text":
            n = len(value.split())
            score = -n if odd else n
        else:
            score = -LEAST_COST if inside else -weights.of_tag(here.kind if here is not None else value)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_span = total, (start, i + 1)
    return found[slice(*best_span)]


def main_text(page: str | None, weights: Weights) -> str:
    parts = []
    for what, value, content in region(page or "", weights):
        if what == "text":
            if content:
                parts.append(html.unescape(value))
        elif value not in INLINE:
            parts.append("\n")
    return " ".join("".join(parts).split())


def fit(pages: DataFrame, text: str = "html", key: str = "page_id", rows: int = TRAIN_PAGES, kinds: int = KINDS) -> list[tuple]:
    """Counts of about `rows` labelled pages, for Weights; of kinds the `kinds` with the most words and tags."""
    known = pages.select(F.col(key).alias("_key"), F.col(text).alias("_html"))
    marked = known.where(F.lower("_html").rlike("<(article|main)[ >]"))
    total = marked.count()
    share = min(1.0, rows / total) if total else 0.0
    sample = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "_key"), F.lit(1_000_000)) < share * 1_000_000)

    def each():
        def step(part):
            counts = Counter()
            for x in part.column("_html").to_pylist():
                count_page(x or "", counts)
            yield {
                "kind": [k for k, _, _ in counts],
                "what": [w for _, w, _ in counts],
                "inside": [i for _, _, i in counts],
                "n": list(counts.values()),
            }

        return step

    counted = batches(sample, "kind string, what string, inside boolean, n long", each).groupBy("kind", "what", "inside").agg(F.sum("n").alias("n"))
    each_kind = counted.groupBy("kind").agg(F.sum("n").alias("total"), F.collect_list(F.struct("kind", "what", "inside", "n")).alias("rows"))
    got = each_kind.orderBy(F.desc("total"), "kind").limit(kinds).collect()
    return [tuple(r) for kind in got for r in kind["rows"]]


def extract(pages: DataFrame, rows: list[tuple], keep: list[str], text: str = "html") -> DataFrame:
    """`keep` columns and `text`, for every row of `pages`; a kept column `text` is named as kept_names() says."""
    kept = kept_names(keep, ["text"])
    frame = pages.select(*(F.col(c).alias(kept[c]) for c in keep), F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in frame.dtypes)

    def each():
        weights = Weights(rows)

        def step(part):
            yield {
                **{c: part.column(c) for c in kept.values()},
                "text": [main_text(x, weights) for x in part.column("text").to_pylist()],
            }

        return step

    return batches(frame, schema, each)
