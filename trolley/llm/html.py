"""Reading HTML into text runs with their tag paths; a small helper of the extraction."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title head tr ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
_CLOSED_BY_SELF = frozenset("li dt dd tr td th option p".split())
# what is no part of an article: tags, and words in class, id or role
OUTSIDE = frozenset("nav header footer aside form menu dialog head title button".split())
# a class, id or role speaks of an aside if it is such a word, or made of such words and of words of place and form;
# a post's or comment's own header or footer is none by its name
_WORD = (
    r"(?:ads?|advert\w*|banner|sidebar|notice|alert|cookies?|consent|comments?|disqus|reply|replies|menu|nav\w*|"
    r"breadcrumbs?|promo\w*|sponsor\w*|share|sharing|social|related|recommended|subscri\w*|"
    r"newsletter|popup|modal|toolbar|pagination|complementary|contentinfo|search)"
)
_EDGE = r"(?:footer|header|masthead)"
_PLACE = (
    r"(?:site|page|main|global|left|right|top|bottom|primary|secondary|container|wrap|wrapper|box|block|area|section|"
    r"list|items?|bar|inner|outer|widgets?|panel|form|signup|links?|buttons?|icons?|slot|unit)"
)
_OWNER = r"(?:user|reader|post|posts|article|articles|story|stories|thread)"
_ASIDE = re.compile(
    rf"(?:^|(?<=\s))(?:(?:(?:{_PLACE}|{_OWNER})[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_EDGE}|{_PLACE}|{_OWNER}))*"
    rf"|(?:{_PLACE}[_-]+)*{_EDGE}(?:[_-]+(?:{_WORD}|{_EDGE}|{_PLACE}))*|widgets?)(?=\s|$)",
    re.I,
)


@dataclass
class Node:
    """An open element: its name with its first class, its path, and whether it is an aside.

    ``outside`` says what its tag and its parents' say; ``named`` elements are asides by
    their names, unless they hold most of a page's text (``settle``).
    """

    tag: str
    path: str
    outside: bool
    named: bool = False
    number: int = 0
    chars: int = 0
    parents: tuple[int, ...] = field(default_factory=tuple)


@dataclass
class Run:
    """A text run: the path and number of its element, its block, and its text."""

    node: Node
    block: int
    text: str


def read(page: str) -> tuple[list[Node], list[Run]]:
    """All elements of a page and its text runs, in order.

    Markup that is not closed ends with its parent; raw text elements, comments and
    declarations are skipped whole; unknown markup is skipped.
    """
    root = Node("", "", False)
    nodes, runs, stack, block = [root], [], [root], 0

    def text(upto: str) -> None:
        if upto:
            runs.append(Run(stack[-1], block, html.unescape(upto)))

    at = 0
    for found in _TOKEN.finditer(page):
        text(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            runs.append(Run(stack[-1], block, " "))
        if tag in BLOCKS:
            block += 1
        if found["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and stack[-1].tag != "p" and tag not in ("li", "td", "th", "tr", "dd", "dt"):
            # a paragraph ends where a block begins, inline elements in between included
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        elif tag in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        if tag in _CLOSED_BY_SELF and stack[-1].tag == tag:
            stack.pop()
        names = " ".join("".join(n) for n in _NAMED.findall(found["rest"] or ""))
        parent = stack[-1]
        first = names.split()[:1]
        node = Node(
            tag,
            f"{parent.path}/{tag}{'.' + first[0].lower() if first else ''}",
            parent.outside or tag in OUTSIDE,
            tag != "body" and tag != "html" and bool(_ASIDE.search(names)),
            len(nodes),
            0,
            (*parent.parents, parent.number),
        )
        nodes.append(node)
        if not (found["rest"] or "").endswith("/") or tag in BLOCKS:
            stack.append(node)
    # what follows a last "<" that never closes is a torn tag
    tail = page[at:]
    torn = re.search(r"<[a-zA-Z/!?][^<>]*\Z", tail)
    text(tail[: torn.start()] if torn else tail)
    return nodes, runs


def _weigh(nodes: list[Node], runs: list[Run]) -> None:
    """Gives each element the characters of the runs below it that are no aside's."""
    for node in nodes:
        node.chars = 0
    for run in runs:
        if not run.node.outside and (n := len("".join(run.text.split()))):
            for number in (*run.node.parents, run.node.number):
                nodes[number].chars += n


def settle(nodes: list[Node], runs: list[Run]) -> None:
    """Marks the named asides and all below them, and weighs the elements by ``runs``.

    An element with more than half of the page's characters is no aside, whatever its name.
    """
    if any(n.named for n in nodes):
        _weigh(nodes, runs)
        for node in nodes[1:]:
            node.outside = node.outside or nodes[node.parents[-1]].outside or (node.named and 2 * node.chars <= nodes[0].chars)
    _weigh(nodes, runs)


def blocks(runs: Iterator[Run]) -> list[str]:
    """The text of each block in order, white space as single spaces, empty ones left out."""
    joined: dict[int, list[str]] = {}
    for run in runs:
        joined.setdefault(run.block, []).append(run.text)
    return [t for parts in joined.values() if (t := " ".join("".join(parts).split()))]
