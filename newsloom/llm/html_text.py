"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf path of block tags. Each path has a text ratio (characters per
node) and a punctuation ratio; both are smoothed with those of the paths beside it under the same parent, fused by product, and
paths above a share of the best are the content, with all that stands below the elements that hold them. What page
structure marks as something else never competes: menus, headers, footers, asides, forms, scripts, styles. An article or
main element weighs for its blocks and a class or id that names an advert, notice or comment against them, so that either
loses to text with a ratio that is better by far.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.shared import in_tasks, sliced

#: Share of the best path's fused ratio that a path needs.
THRESHOLD = 0.02
#: Weight of the neighbours in the smoothing.
BESIDE = 0.5
#: Weights of the ratios of blocks outside a page's articles, and of those below an element with such a name.
OUTSIDE, NAMED = 0.1, 0.05
#: Elements that belong to the text they stand in.
TEXT_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote figure figcaption pre".split())

RAW = frozenset("script style noscript template iframe textarea title svg math canvas object noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset("nav footer aside button select menu dialog head fieldset label option datalist".split())
#: Elements that mostly hold something else, but on some pages the whole article: their blocks compete with a lesser weight.
DOUBTFUL = frozenset("form header".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Tags that end an open one of the same kind, up to the container named.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed)?|promo(?:tion)?s?|sidebars?|side|comments?|"
    r"disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|newsletters?|"
    r"subscri(?:be|ption)|signup|share|sharing|social|related|recommend(?:ed|ations)?|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|toolbar|pagination|pager|widgets?|login|search|skip|hidden)(?:$|[-_\s\d])",
    re.I,
)
_OWN_NAMED = re.compile(r"(?:^|\s)(?:comments?|repl(?:y|ies)|respond|related|promos?|ads?|adverts?|sponsored)(?:$|[-_\s\d])", re.I)
#: Class names that say what stands beside an element, and that an article's own header bears.
_BESIDE_NAMED = re.compile(r"(?<![^\s])(?:has|with|no|without)[-_][^\s]*", re.I)
_HEADER_NAMED = re.compile(r"(?<![^\s])(?:[^\s]*[-_])?header(?![^\s])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¡¿]")


@dataclass
class Block:
    """Text of one block element between two block boundaries."""

    path: tuple[str, ...]
    excluded: bool
    #: Numbers of the elements of `path` in the page, and of those above whose names speak against the block.
    nodes: tuple[int, ...] = ()
    named: tuple[int, ...] = ()
    pieces: list[str] = field(default_factory=list)
    #: Whether all its text is that of links.
    linked: bool = True

    def marked(self) -> bool:
        return "article" in self.path or "main" in self.path

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


#: What an element is: content, content unless its name is right, or something else.
CONTENT, DOUBTED, OTHER = range(3)


def _kind(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is something other than content, or likely is; an article's own header belongs to it."""
    if tag in ("html", "body", "main"):
        return CONTENT
    if tag in NOT_CONTENT:
        return OTHER
    doubted = tag in DOUBTFUL and not (tag == "header" and inside)
    if not attributes:
        return DOUBTED if doubted else CONTENT
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if values.get("role", "").lower() in _ROLES or values.get("aria-hidden", "").lower() == "true":
        return OTHER
    if any(name == "hidden" for name in attributes.lower().split()):
        return OTHER
    if re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        return OTHER
    names = [_BESIDE_NAMED.sub(" ", values.get(name, "")) for name in ("class", "id")]
    if tag == "article":
        return DOUBTED if any(map(_OWN_NAMED.search, names)) else CONTENT
    if inside:
        names = [_HEADER_NAMED.sub(" ", name) for name in names]
    return DOUBTED if doubted or any(map(_NAMED.search, names)) else CONTENT


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Tags are closed where HTML implies it; a page cut off anywhere is read to its end."""
    stack: list[tuple[str, int, int]] = []
    number = 0
    found: list[Block] = []
    current: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if not text or current is None and text.isspace():
            return
        if current is None:
            outer = [(tag, at) for tag, _, at in stack if tag not in INLINE]
            named = tuple(at for _, kind, at in stack if kind == DOUBTED)
            current = Block(tuple(tag for tag, _ in outer), any(kind == OTHER for _, kind, _ in stack), tuple(at for _, at in outer), named)
            found.append(current)
        current.pieces.append(text)
        if current.linked and not text.isspace() and all(tag != "a" for tag, *_ in stack):
            current.linked = False

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Pops up to the nearest open one of `tags`, unless one of `stop` lies above it."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                del stack[depth:]
                return
            if stack[depth][0] in stop:
                return

    while match := _MARKUP.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            if match[0].startswith("<![CDATA["):
                add(match[0][9:-3])
            continue
        ends, attributes = match[1] == "/", match[3]
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            current = None
        if ends:
            close({tag}, frozenset({"td", "th", "table"}) - {tag} if tag in INLINE or tag == "p" else frozenset())
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "button", "table"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        number += 1
        if tag in INLINE:
            hidden = "hidden" in attributes.lower().split()
            stack.append((tag, OTHER if hidden else CONTENT, number))
            current = None if hidden else current
            continue
        stack.append((tag, _kind(tag, attributes, any(open_tag in ("article", "main") for open_tag, *_ in stack)), number))
    add(page[at:])
    return found


def path_scores(blocks: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused ratio of each path: smoothed characters per node times smoothed punctuation per node."""
    texts: dict[tuple[str, ...], list[float]] = {}
    for block in blocks:
        text = block.text()
        if text:
            sums = texts.setdefault(block.path, [0.0, 0.0, 0.0])
            sums[0] += 1
            sums[1] += len(text)
            sums[2] += len(_PUNCTUATION.findall(text))
    parents: dict[tuple[str, ...], list[float]] = {}
    for path, sums in texts.items():
        whole = parents.setdefault(path[:-1], [0.0, 0.0, 0.0])
        for at in range(3):
            whole[at] += sums[at]
    scores = {}
    for path, (nodes, length, marks) in texts.items():
        every, all_length, all_marks = parents[path[:-1]]
        text = (1 - BESIDE) * length / nodes + BESIDE * all_length / every
        punctuation = (1 - BESIDE) * marks / nodes + BESIDE * all_marks / every
        scores[path] = text * (1 + punctuation)
    return scores


def _competing(blocks: list[Block]) -> tuple[list[Block], list[Block]]:
    """The blocks among which ratios choose, and all that may be lifted with them.

    Blocks compete in groups by where they stand: in an article or main element or outside, and below which doubted
    names. The group with the best weighted ratio wins; the names above it are no longer doubted, all others are.
    """
    groups: dict[tuple[bool, tuple[int, ...]], list[Block]] = {}
    for block in blocks:
        if block.text():
            groups.setdefault((block.marked(), block.named), []).append(block)
    if not groups:
        return [], []
    marks = any(marked for marked, _ in groups)

    def weighted(key: tuple[bool, tuple[int, ...]]) -> float:
        marked, named = key
        return max(path_scores(groups[key]).values()) * (OUTSIDE if marks and not marked else 1) * (NAMED if named else 1)

    marked, named = max(groups, key=weighted)
    sound = [block for block in blocks if set(block.named) <= set(named)]
    return [block for block in sound if block.marked() == marked], sound


def _roots(block: Block) -> int | None:
    """The outermost article around a block, else its main element, else what it stands in; None in the page itself."""
    for tag in ("article", "main"):
        if tag in block.path:
            return block.nodes[block.path.index(tag)]
    return block.nodes[-2] if len(block.path) > 1 and block.path[-2] not in ("html", "body") else None


def _beside(block: Block) -> bool:
    """Whether a block stands in the page itself, or in lists, tables and the like there, and is more than links."""
    return not block.linked and all(tag in TEXT_PARTS for tag in block.path if tag not in ("html", "body"))


def main_text(page: str | None) -> str:
    """The article of a page: its content blocks in page order, one per line; empty if there is none.

    Ratios choose paths. Every sound block below an element that holds the best one belongs to the article too, however
    short: list items, table cells, captions, quotes.
    """
    blocks, sound = _competing([block for block in blocks_of(page or "") if not block.excluded])
    scores = path_scores(blocks)
    best = max(scores.values(), default=0.0)
    chosen = {id(block) for block in blocks if scores.get(block.path, 0.0) >= THRESHOLD * best}
    roots = {_roots(block) for block in blocks if scores.get(block.path, 0.0) == best}
    lifted = {id(block) for block in sound if not roots.isdisjoint(block.nodes) or None in roots and _beside(block)}
    lines = [block.text() for block in sound if id(block) in chosen or id(block) in lifted]
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `carry` of each row with text and n_chars (code points) of its page's main text.

    NULL and empty pages give an empty text; pages of any length are read whole; equal rows come out as often as they
    came in; columns not carried are ignored, so their names can't clash. No rows give no rows.
    """
    chosen = pages.select(*carry, F.col(html_column).alias("_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(carry)):
            texts = [main_text(page.as_py()) for page in batch.column(len(carry))]
            columns = [pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*carry, "text", "n_chars"])

    rest = T._parse_datatype_string("text string, n_chars bigint")
    return in_tasks(chosen, read, T.StructType([*chosen.schema.fields[:-1], *rest]))
