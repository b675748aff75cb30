"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text. A classifier over a block's place, the names
and tags around it, what else these hold, and its wording gives it a cost for being left out and one for being kept, which become
capacities to the two terminals; neighbours on the page and in the document
tree are joined by smoothness edges. The minimum cut labels all blocks at once:
a doubtful block follows its surroundings, a clear one does not.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

from pyspark.sql import DataFrame, types as T

from gneiss.llm.arrow import map_texts

#: Fixed names of elements: those that end a block, those without content, and those whose content is never text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template head title svg annotation annotation-xml iframe canvas audio video select option datalist textarea button noframes".split())
CLOSES_P = BLOCK - {"body", "html"}
#: Weights of elements around a block; the strongest of each sign counts.
AROUND = {"article": 3.0, "main": 2.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "menu": -9.0, "dialog": -9.0, "header": -4.0, "fieldset": -6.0}
#: Words in class, id and role names of page furniture, of readers' comments, and of content.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead side sidebar ad ads adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search social share sharing related recommended recommendations trending popular widget toolbar pagination pager tags copyright legal hidden skip contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
CONTENT = frozenset("article articlebody content entry post story main body text prose".split())
#: Words that say what kind of element a name belongs to, not what is in it.
SHAPE = frozenset("list area section wrapper wrap container box links link form item items bar block inner outer content body text module panel group row col".split())
#: What a name weighs that is, or ends in, such a word; one that only mentions it; a form; and furniture's header inside an article.
NAMED, MENTIONED, FORM, OWN_HEADER = -7.0, -3.5, -9.0, -1.0
#: A penalty for a name, or for a form, is lifted from an element with this share of the page's prose (for readers'
#: comments nearly all of it), if no more than LEFT_OUT of the prose stands in content elements outside it.
MOST, NEARLY_ALL, LEFT_OUT = 0.5, 0.9, 0.1
NOTICE = re.compile(r"©|\(c\) \d{4}|all rights reserved|accept (?:all )?cookies|we use cookies|terms of (?:use|service)|privacy policy|subscribe to|sign up|log ?in|advertisement|sponsored|share (?:this|on)|read more|click here", re.I)
SENTENCE = re.compile(r"[.!?…]['\"”’)]*(?:\s|$)")
#: Capacity between neighbours on the page, and between neighbouring children of one element.
ADJACENT, SIBLING = 1.0, 1.5
#: Capacities no larger are full.
LEAST = 1e-12

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*))>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names in which a part of the page is only said to be there or not.
SAID = re.compile(r"(?:has|have|no|not|with|without|is|js|show|hide|hides|toggle|category|tag|type|status|format)[_-][\w-]+|[\w-]+[_-](?:open|opened|closed|enabled|disabled|on|off|active|inactive)")
WORDS = re.compile(r"(?<=[a-z])(?=[A-Z])|[_-]+")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_SHOWN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements whose text ends only with their own end tag; of the others an end tag may be missing.
TO_THE_END = frozenset(("script", "style"))


def is_hidden(attributes: str) -> bool:
    """Whether an element's own attributes, read by name, keep it from being shown."""
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next(filter(None, values), ""), name.lower()
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


class Block:
    __slots__ = ("text", "tag", "path", "score", "links", "size", "inside")

    def __init__(self, text: str, tag: str, path: tuple[int, ...], links: int, inside: int):
        self.text, self.tag, self.path, self.links, self.size, self.inside, self.score = text, tag, path, links, len(text), inside, 0.0

    def prose(self) -> int:
        """Words, unless most of the block is links."""
        return self.text.count(" ") + 1 if 2 * self.links < self.size else 0


class Element:
    """An open or closed element: its parent's number, and what its own tag and names say of the text in it.

    hard holds whatever the page looks like, soft only unless the element has
    the share of the page's prose given by most.
    """

    __slots__ = ("parent", "name", "good", "hard", "soft", "most", "mass", "content")

    def __init__(self, parent: int, name: str, attributes: str):
        self.parent, self.name = parent, name
        own = AROUND.get(name, 0.0)
        self.good, self.hard, self.soft, self.most, self.mass, self.content = max(own, 0.0), min(own, 0.0), FORM if name == "form" else 0.0, MOST, 0, 0
        if attributes and name not in ("html", "body"):
            for groups in NAMES.findall(attributes):
                for token in next(filter(None, groups), "").split():
                    self.named(token)
            if is_hidden(attributes):
                self.hard = min(self.hard, -8.0)
        if self.soft:
            self.good = self.good if name in ("article", "main") and self.soft > NAMED else 0.0

    def named(self, token: str) -> None:
        """Takes in one whole token of a class, id or role."""
        if SAID.fullmatch(token.lower()):
            return
        parts = [x for x in WORDS.sub(" ", token).lower().split() if not x.isdigit()]
        of = [x for x in parts if x in FURNITURE or x in COMMENTS or x.startswith("advert")]
        if of:
            while len(parts) > 1 and parts[-1] in SHAPE:
                parts.pop()
            meant = parts[-1] == of[-1]
            if meant or self.name not in ("article", "main"):
                self.soft = min(self.soft, NAMED if meant else MENTIONED)
                if meant and of[-1] in COMMENTS:
                    self.most = NEARLY_ALL
        elif CONTENT.intersection(parts):
            self.good = max(self.good, 2.0)


def score_blocks(blocks: list[Block], elements: list[Element]) -> None:
    """Sets each block's score: the strongest good and the strongest bad that its elements, judged by what they hold, say of it."""
    #: Whether an element, or one around it, is always furniture; whether one is content.
    hard, content = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements):
        if i:
            hard[i] = hard[e.parent] or e.hard <= -6.0
            content[i] = content[e.parent] or e.good > 0
    for b in blocks:
        if not hard[b.inside]:
            words = b.prose()
            elements[b.inside].mass += words
            elements[b.inside].content += words if content[b.inside] else 0
    for e in reversed(elements[1:]):
        elements[e.parent].mass += e.mass
        elements[e.parent].content += e.content
    total, in_content = elements[0].mass, elements[0].content
    best, worst = [0.0] * len(elements), [0.0] * len(elements)
    for i, e in enumerate(elements):
        if i:
            bad = e.hard
            holds_page = total and e.mass >= e.most * total and in_content - e.content <= LEFT_OUT * total
            if e.soft and not holds_page:
                bad = min(bad, e.soft)
            if e.name == "header" and best[e.parent] >= 3.0:
                bad = max(bad, OWN_HEADER)
            best[i], worst[i] = max(best[e.parent], e.good), min(worst[e.parent], bad)
    for b in blocks:
        b.score = best[b.inside] + worst[b.inside]


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order: text between block elements, white space turned into single spaces."""
    out: list[Block] = []
    elements = [Element(0, "", "")]
    #: Open elements: name and number.
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked = 0  # characters of links in the current block
    links_open = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((n for n, _ in reversed(stack) if n in BLOCK), "body")
                out.append(Block(text, tag, tuple(i for n, i in stack if n in BLOCK), min(linked, len(text)), stack[-1][1] if stack else 0))
            pieces.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        upto = m.start() if m else size
        if upto > at:
            piece = unescape(html[at:upto])
            pieces.append(piece)
            if links_open:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                end_block()
            elif name == "a":
                links_open = 0
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None and (name in BLOCK or not any(n in BLOCK for n, _ in stack[k:])):
                del stack[k:]
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            own = m[3] if m[2] else m[6] or ""
            if not close and name not in TO_THE_END or name == "svg" and own.rstrip().endswith("/"):
                continue
            if name in BLOCK or name in ("select", "textarea", "button"):
                end_block()
            at = close.end() if close else size
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            end_block()
            if name in CLOSES_P:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), None)
                if k is not None and (stack[k][0] == "p" or stack[k][0] == name and name in ("li", "td", "th", "tr", "dd", "dt")):
                    del stack[k:]
            links_open = 0
        if name in VOID:
            continue
        attributes = m[3] if m[2] else m[6] or ""
        elements.append(Element(stack[-1][1] if stack else 0, name, attributes))
        stack.append((name, len(elements) - 1))
        if name == "a":
            links_open = 1
    end_block()
    score_blocks(out, elements)
    return out


def cost(block: Block) -> float:
    """How much more it costs to leave a block out than to keep it; negative for page furniture."""
    words = block.text.count(" ") + 1
    value = block.score - 0.5
    value += min(1.5, 0.5 * math.log1p(words / 8))
    value += 0.7 if SENTENCE.search(block.text) else -0.3
    value -= 3.0 * block.links / max(block.size, 1)
    if block.tag in ("h1", "h2", "h3"):
        value += 0.7
    if words < 40 and NOTICE.search(block.text):
        value -= 3.0
    return value


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbours on the page, by their common ancestors, and between neighbouring children of one element."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            common = sum(1 for x, y in zip(a.path, b.path, strict=False) if x == y)
            edges[i - 1, i] = ADJACENT * common / max(len(a.path), len(b.path), 1)
        parent = b.path[-2] if len(b.path) > 1 else 0
        if (j := last.get(parent)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING * (1.0 if blocks[j].tag == b.tag else 0.5)
        last[parent] = i
    return edges


def levels(residual: dict[int, dict[int, float]], source: int, sink: int) -> dict[int, int]:
    """Steps from the source to each node that open capacity reaches; those from the sink on may be missing."""
    level, queue = {source: 0}, deque([source])
    while queue and sink not in level:
        u = queue.popleft()
        for v, c in residual[u].items():
            if c > LEAST and v not in level:
                level[v] = level[u] + 1
                queue.append(v)
    return level


def blocking_flow(residual: dict[int, dict[int, float]], level: dict[int, int], source: int, sink: int) -> None:
    """Pushes flow from level to level until every such path to the sink has a full edge; each edge is left behind once."""
    ahead = {u: [v for v in residual[u] if level.get(v, -1) == level[u] + 1] for u in level}
    path = [source]
    while path:
        u = path[-1]
        if u == sink:
            steps = list(zip(path, path[1:], strict=False))
            flow = min(residual[a][b] for a, b in steps)
            full = len(path)
            for at, (a, b) in enumerate(steps):
                residual[a][b] -= flow
                residual[b][a] = residual[b].get(a, 0.0) + flow
                if residual[a][b] <= LEAST:
                    full = min(full, at + 1)
            del path[full:]
        elif ahead[u]:
            v = ahead[u][-1]
            if residual[u][v] > LEAST:
                path.append(v)
            else:
                ahead[u].pop()
        else:
            path.pop()
            if path:
                ahead[path[-1]].pop()


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least total cost: True where a node stays on the source's side.

    unary is the cost of False minus the cost of True. A node whose own cost
    outweighs all its open edges keeps its sign in every minimum cut, so it is
    labelled and its edges are folded into its neighbours; what is left is
    solved by blocking flows over the levels of a breadth-first search.
    """
    n = len(unary)
    value, near = list(unary), [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if w > 0 and a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(value[i]) >= sum(near[i].values()):
            label[i] = value[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                value[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        source, sink = n, n + 1
        residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in open_nodes}
        residual[source], residual[sink] = {}, {}
        for i in open_nodes:
            if value[i] > 0:
                residual[source][i] = value[i]
                residual[i][source] = 0.0
            elif value[i] < 0:
                residual[i][sink] = -value[i]
                residual[sink][i] = 0.0
        while (level := levels(residual, source, sink)).get(sink):
            blocking_flow(residual, level, source, sink)
        for i in open_nodes:
            label[i] = i in level
    return [bool(x) for x in label]


def main_text(html: str) -> str:
    """The blocks on the content side of the cut, one a line; empty if there is none."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    keep = minimum_cut([cost(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text (main text) and n_chars (its code points) for every page.

    A null or empty page, and one without content, has the empty text. Pages
    are judged alone: repeated rows agree, order does not matter, columns not
    kept are not read, and an empty table gives an empty result. Clear blocks
    are labelled in time linear in their number; those left open take a few
    blocking flows, each linear in them.
    """

    def factory():
        def work(texts: list[str]) -> list[list]:
            found = list(map(main_text, texts))
            return [found, list(map(len, found))]

        return work

    return map_texts(pages, html, list(keep), [("text", T.StringType()), ("n_chars", T.LongType())], factory)
