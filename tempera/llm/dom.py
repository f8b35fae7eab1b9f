"""A page as a tree of blocks with features per node; helpers of the main-text extractor."""

from __future__ import annotations

import html
import math
import re

import numpy as np

# HTML's element classes and the tokens that sites commonly use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements that may be closed by their own "/>".
SELF_CLOSED = frozenset("svg math object canvas template".split())
DROPPED = RAW | frozenset("head select option datalist button input svg object canvas template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul head".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body head legend".split())
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav".split())
TOKENS = {
    "content": "article articlebody content contents post posts entry main story body text blog hentry prose copy news page",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs skip links",
    "header": "header head masthead topbar top logo brand banner hero tagline",
    "footer": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget widgets rail related recommended more popular trending tags archive complementary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adsbox commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast message newsletter subscribe signup paywall",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback review reviews reader readers",
    "form": "form search login share sharing social button buttons btn rating vote contact register",
}
GROUP = {token: i for i, words in enumerate(TOKENS.values()) for token in words.split()}
N_GROUPS = len(TOKENS)
TAG_CLASSES = (
    "article main", "section div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dd dt", "nav", "header", "footer", "aside",
    "form fieldset search", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption details summary", "body html",
)
TAG_CLASS = {t: i for i, tags in enumerate(TAG_CLASSES) for t in tags.split()}
INLINE = len(TAG_CLASSES)
SECTION = frozenset("article main".split())
OUTSIDE = frozenset("nav header footer aside form search".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_NAMED = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")
MARK = "data-kept"

FEATURES = (
    *(f"is_{i}" for i in range(INLINE + 1)), *(f"own_{g}" for g in TOKENS), *(f"above_{g}" for g in TOKENS),
    "in_section", "in_outside", "depth", "chars", "words", "link_share", "stops", "share", "nodes", "chars_per_node",
    "paragraphs", "index", "siblings", "like_siblings", "sibling_chars", "page_chars", "loose",
)


class Page:
    """Nodes in page order: ``parent`` and parallel lists; ``blocks`` are lists of (node, text)."""

    __slots__ = ("parent", "tag", "groups", "dropped", "marked", "blocks", "links")

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.dropped, self.marked = [-1], ["body"], [0], [False], [False]
        self.links: list[int] = [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements with the node their text belongs to
        block: list[tuple[int, str]] = []
        in_link = at = 0

        def text(upto: int) -> None:
            if upto > at:
                piece = html.unescape(source[at:upto])
                node = stack[-1][1]
                block.append((node, piece))
                if in_link:
                    self.links[node] += len(piece.strip())

        def flush() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def leave(depth: int) -> None:
            nonlocal in_link
            for name, _ in stack[depth:]:
                if name == "a":
                    in_link -= 1
                if name in BLOCK:
                    flush()
            del stack[depth:]

        for m in iter(lambda: _TAG.search(source, at), None):
            text(m.start())
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if name == "br" or name in VOID:
                    block.append((stack[-1][1], " "))
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        leave(i)
                        break
                    if name not in BLOCK and stack[i][0] in BLOCK and name != "a":
                        break
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    block.append((stack[-1][1], " "))
                continue
            if name in RAW:
                end = _RAW_END[name].search(source, at)
                at = end.start() if end else len(source)
                continue
            if name in SELF_CLOSED and attributes.rstrip().endswith("/"):
                continue
            if name in ("html", "body"):
                if len(stack) > 1 and stack[1][0] == "head":
                    leave(1)
                continue
            if stack[-1][0] == "head":
                leave(len(stack) - 1)
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        leave(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in IMPLIED.get(name, ()):
                    leave(i)
                    break
                if stack[i][0] in SCOPES:
                    break
            is_block = name in BLOCK
            if is_block:
                flush()
            elif name == "a":
                in_link += 1
            node, groups = stack[-1][1], 0
            if attributes:
                for value in _NAMED.findall(attributes):
                    for part in _PARTS.findall("".join(value).lower()):
                        groups |= 1 << GROUP[part] if part in GROUP else 0
            if is_block or groups or name in DROPPED or MARK in attributes:
                self.parent.append(node)
                node = len(self.tag)
                self.tag.append(name)
                self.groups.append(groups)
                self.dropped.append(name in DROPPED or bool(attributes and _HIDDEN.search(attributes)))
                self.marked.append(MARK in attributes)
                self.links.append(0)
            stack.append((name, node))
        text(len(source))
        flush()
        self._part_loose_text()

    def _part_loose_text(self) -> None:
        """Text that stands beside blocks in one element becomes a node of its own."""
        holds = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            if self.tag[i] in BLOCK:
                holds[self.parent[i]] = True
        loose: dict[int, int] = {}
        for block in self.blocks:
            for k, (node, piece) in enumerate(block):
                if holds[node] and not piece.isspace():
                    if node not in loose:
                        loose[node] = len(self.tag)
                        self.parent.append(node)
                        self.tag.append("#text")
                        self.groups.append(0)
                        self.dropped.append(False)
                        self.marked.append(False)
                        self.links.append(self.links[node])
                        self.links[node] = 0
                    block[k] = (loose[node], piece)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, words, stops, links = [0] * n, [0] * n, [0] * n, list(self.links)
        for block in self.blocks:
            for node, piece in block:
                chars[node] += len(piece.strip())
                words[node] += piece.count(" ") + 1
                stops[node] += piece.count(".") + piece.count(",")
        nodes, paragraphs, children = [1] * n, [int(t == "p") for t in self.tag], [[] for _ in range(n)]
        order = [0]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        for i in order:
            order += children[i]
        for i in reversed(order):
            p = self.parent[i]
            if p >= 0:
                for column in (chars, words, stops, links, nodes, paragraphs):
                    column[p] += column[i]
        out = np.zeros((n, len(FEATURES)), np.float32)
        above, depth, section, outside = [0] * n, [0] * n, [False] * n, [False] * n
        total = max(1, chars[0])
        base = INLINE + 1
        for i in order:
            p, tag = self.parent[i], self.tag[i]
            if p >= 0:
                above[i], depth[i] = above[p] | self.groups[p], depth[p] + 1
            section[i] = tag in SECTION or (p >= 0 and section[p])
            outside[i] = tag in OUTSIDE or (p >= 0 and outside[p])
            row = out[i]
            row[TAG_CLASS.get(tag, INLINE)] = 1
            if self.groups[i] or above[i]:
                for g in range(N_GROUPS):
                    row[base + g] = self.groups[i] >> g & 1
                    row[base + N_GROUPS + g] = above[i] >> g & 1
            c = chars[i]
            row[base + 2 * N_GROUPS :] = (
                section[i], outside[i], depth[i], math.log1p(c), math.log1p(words[i]), links[i] / max(1, c),
                stops[i] / max(1, words[i]), c / total, nodes[i], c / nodes[i], paragraphs[i], 0, 1, 1, c, math.log1p(total), tag == "#text",
            )
        at = base + 2 * N_GROUPS + 11
        for i in range(n):
            kids = children[i]
            if kids:
                mean = sum(chars[k] for k in kids) / len(kids)
                tags: dict[str, int] = {}
                for k in kids:
                    tags[self.tag[k]] = tags.get(self.tag[k], 0) + 1
                for j, k in enumerate(kids):
                    out[k, at : at + 4] = (j, len(kids), tags[self.tag[k]] / len(kids), math.log1p(mean))
        out[0, at + 3] = 0
        return out

    def labels(self) -> np.ndarray:
        """1 for nodes that are marked, lie in a marked one, or hold one."""
        out = list(self.marked)
        for i in range(1, len(out)):
            out[i] = out[i] or self.marked_above(i)
        for i in range(len(out) - 1, 0, -1):
            # Loose text follows all elements, so children always come after their parents.
            if out[i]:
                out[self.parent[i]] = True
        return np.asarray(out, np.float64)

    def marked_above(self, i: int) -> bool:
        while i > 0:
            if self.marked[i]:
                return True
            if self.dropped[i]:
                return False
            i = self.parent[i]
        return False

    def decide(self, chance: np.ndarray) -> list[bool]:
        """The most likely choice in which a node is kept only if its parent is, and a kept one has kept text.

        Per node the log odds are weighed by its text; from the leaves up, keeping a
        node allows the better choice for each child, dropping it drops them all.
        """
        n = len(self.tag)
        own = [0] * n
        for block in self.blocks:
            for node, piece in block:
                own[node] += len(piece.strip())
        p = np.clip(chance, 1e-4, 1 - 1e-4)
        gain = np.log(p / (1 - p)) * (1 + np.log1p(np.asarray(own)))
        best = gain.tolist()  # of keeping a node, against dropping its subtree
        some = [o > 0 for o in own]
        least = [(-math.inf, 0)] * n  # the child that costs least, for nodes without text or a child worth keeping
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not some[i]:
                best[i] += least[i][0]
            if self.dropped[i]:
                best[i] = -math.inf
            elif best[i] > 0:
                best[p] += best[i]
                some[p] = True
            least[p] = max(least[p], (best[i], i))
        kept = [False] * n
        kept[0] = True
        for i in range(1, n):
            p = self.parent[i]
            kept[i] = kept[p] and (best[i] > 0 or (p > 0 and not some[p] and least[p][1] == i))
        return kept

    def main_text(self, chance: np.ndarray) -> str:
        kept = self.decide(chance)
        lines = (" ".join("".join(piece for node, piece in block if kept[node]).split()) for block in self.blocks)
        return "\n".join(line for line in lines if line)
