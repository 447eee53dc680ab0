"""A forgiving HTML reader that keeps block elements with their texts, and figures for each of them."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

import numpy as np

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")

#: HTML's element classes, as its standard lists them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Scripts and what stands in for them, styles, forms, and other documents; all else keeps its text.
DROPPED = frozenset("script noscript template style title iframe svg textarea select button".split())
_ENDS_P = BLOCKS - frozenset("body caption dd dt legend li tbody td tfoot th thead tr summary figcaption".split())
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}
_P_WALLS = frozenset("table td th caption body".split())

#: Words in class, id and role attributes, by what they commonly name.
TOKEN_GROUPS = (
    frozenset("nav menu breadcrumb breadcrumbs navbar navigation pagination pager toc tabs".split()),
    frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp".split()),
    frozenset("comment comments reply replies discussion disqus respond feedback".split()),
    frozenset("sidebar aside related widget widgets recommended recommendations trending popular more teaser".split()),
    frozenset("footer foot copyright legal bottom colophon contentinfo".split()),
    frozenset("header head masthead logo top brand hero".split()),
    frozenset("cookie cookies notice consent popup modal alert overlay gdpr warning newsletter subscribe signup paywall".split()),
    frozenset("article post entry content main story text prose body page".split()),
    frozenset("share sharing social follow tags meta byline author date".split()),
    frozenset("form search login input contact".split()),
)
TAG_GROUPS = (("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu"), ("div", "center"), ("section", "details"), ("article",), ("main",), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body",))
_GROUP_OF = {t: k for k, ts in enumerate(TAG_GROUPS) for t in ts}
_INHERITED = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "article": 4, "main": 5, "form": 6}


class Page:
    """tag, parent, depth and attribute groups of each block element in page order; blocks: (element, text).

    label: for pages made for training (labelled), the value of each element's attribute data-y; else None.
    """

    __slots__ = ("tag", "parent", "groups", "label", "blocks", "links", "n_links", "labelled")

    def __init__(self, html: str, labelled: bool = False):
        self.labelled = labelled
        self.tag, self.parent, self.groups, self.label = ["body"], [-1], [0], [None]
        self.blocks: list[tuple[int, str]] = []
        self.links, self.n_links = [0], [0]
        self._read(html)

    def _read(self, html: str) -> None:
        stack, parts, in_link, at, n = [0], [], False, 0, len(html)
        search = _TAG.search
        open_at: dict[str, list[int]] = {}

        def close_run() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1], text))
                parts.clear()

        def add(text: str) -> None:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                self.links[stack[-1]] += len(text)

        while at < n:
            m = search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in BLOCKS:
                if end:
                    if name == "body":
                        continue
                    if open_at.get(name):
                        close_run()
                        self._close(stack, open_at, open_at[name][-1])
                    continue
                if name == "body":
                    self.groups[0], self.label[0] = self._attributes(attributes)
                    continue
                close_run()
                if name in _ENDS_P:
                    self._pop(stack, open_at, {"p"}, _P_WALLS)
                if name in _CLOSES:
                    self._pop(stack, open_at, _CLOSES[name], _WALLS[name])
                if name == "hr":
                    continue
                groups, label = self._attributes(attributes)
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.groups.append(groups)
                self.label.append(label)
                self.links.append(0)
                self.n_links.append(0)
                open_at.setdefault(name, []).append(len(stack))
                stack.append(len(self.tag) - 1)
            elif name in DROPPED:
                if not end and not attributes.endswith("/"):
                    stop = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
                    at = n if stop is None else (html.find(">", stop.end()) + 1 or n)
            elif name == "a":
                in_link = not end
                if in_link:
                    self.n_links[stack[-1]] += 1
            elif name == "br":
                parts.append(" ")
            elif name == "head" and end:
                parts.clear()
        close_run()

    def _attributes(self, attributes: str) -> tuple[int, int | None]:
        groups, label = _groups(attributes) if attributes else (0, None)
        return groups, label if self.labelled else None

    def _close(self, stack: list[int], open_at: dict[str, list[int]], cut: int) -> None:
        """Close the open elements from place `cut` on."""
        while len(stack) > cut:
            open_at[self.tag[stack.pop()]].pop()

    def _pop(self, stack: list[int], open_at: dict[str, list[int]], names: set[str], walls: frozenset[str] | set[str]) -> None:
        """Close open elements down to the outermost of `names` inside the nearest wall. A name is no wall to itself.

        open_at: the places of the open elements of each name, so the depth does not count.
        """
        wall = max((open_at[w][-1] for w in walls if w not in names and open_at.get(w)), default=0)
        cuts = [places[k] for name in names if (places := open_at.get(name)) and (k := bisect_right(places, wall)) < len(places)]
        if cuts:
            self._close(stack, open_at, min(cuts))

    def features(self) -> np.ndarray:
        """A row for each element; see NAMES for the columns."""
        n = len(self.tag)
        own, words, marks, runs, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        total = 0
        for k, text in self.blocks:
            own[k] += len(text)
            words[k] += text.count(" ") + 1
            marks[k] += len(_PUNCTUATION.findall(text))
            runs[k] += 1
        children: list[list[int]] = [[] for _ in range(n)]
        depth, inside, above, place = [0] * n, [0] * n, [0] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}
        for k in range(1, n):
            p = self.parent[k]
            place[k] = len(children[p])
            children[p].append(k)
            alike[p, self.tag[k]] = alike.get((p, self.tag[k]), 0) + 1
            depth[k] = depth[p] + 1
            flag = _INHERITED.get(self.tag[k])
            inside[k] = inside[p] | (1 << flag if flag is not None else 0)
            above[k] = above[p] | self.groups[p]
        text, link, anchors, size, w, pm, blocks, paragraphs = own[:], self.links[:], self.n_links[:], [1] * n, words[:], marks[:], runs[:], [int(t == "p") for t in self.tag]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            text[p] += text[k]
            link[p] += link[k]
            anchors[p] += anchors[k]
            size[p] += size[k]
            w[p] += w[k]
            pm[p] += pm[k]
            blocks[p] += blocks[k]
            paragraphs[p] += paragraphs[k]
        for k in range(n):
            before[k] = total
            total += own[k]
        whole = max(1, text[0])
        rows = np.zeros((n, len(NAMES)))
        log = math.log1p
        for k in range(n):
            p = max(0, self.parent[k])
            around = children[p] if k else [0]
            same = alike[p, self.tag[k]] if k else 1
            at = place[k]
            rows[k, :20] = (
                depth[k], log(own[k]), log(text[k]), link[k] / max(1, text[k]), text[k] / size[k], log(anchors[k]), text[k] / whole, before[k] / whole,
                w[k] / max(1, blocks[k]), pm[k] / max(1, w[k]), len(around), at / max(1, len(around)), same, text[k] / max(1, text[p]),
                log(text[around[at - 1]]) if 0 < at < len(around) else -1, log(text[around[at + 1]]) if at + 1 < len(around) else -1,
                link[p] / max(1, text[p]), log(text[p]), paragraphs[k], log(size[k]),
            )
            rows[k, 20 + _GROUP_OF.get(self.tag[k], 5)] = 1
            rows[k, _AT_OWN:_AT_ABOVE] = [self.groups[k] >> j & 1 for j in range(len(TOKEN_GROUPS))]
            rows[k, _AT_ABOVE:_AT_INSIDE] = [above[k] >> j & 1 for j in range(len(TOKEN_GROUPS))]
            rows[k, _AT_INSIDE:] = [inside[k] >> j & 1 for j in range(len(_INHERITED))]
        return rows


_AT_OWN = 20 + len(TAG_GROUPS)
_AT_ABOVE = _AT_OWN + len(TOKEN_GROUPS)
_AT_INSIDE = _AT_ABOVE + len(TOKEN_GROUPS)
NAMES = [
    "depth", "own_text", "subtree_text", "link_density", "text_density", "links", "page_share", "page_place", "words_per_block", "punctuation", "siblings", "sibling_place", "same_siblings", "sibling_share",
    "previous_text", "next_text", "parent_link_density", "parent_text", "paragraphs", "subtree_size",
    *(f"tag_{g[0]}" for g in TAG_GROUPS), *(f"token_{k}" for k in range(len(TOKEN_GROUPS))), *(f"above_{k}" for k in range(len(TOKEN_GROUPS))), *(f"in_{t}" for t in _INHERITED),
]


def _groups(attributes: str) -> tuple[int, int | None]:
    """Which token groups the attributes name, as bits, and the training label, if any."""
    bits, label = 0, None
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            label = int(value == "1")
            continue
        tokens = {t.lower() for t in _TOKEN.findall(value)}
        for k, group in enumerate(TOKEN_GROUPS):
            if tokens & group:
                bits |= 1 << k
    return bits, label
