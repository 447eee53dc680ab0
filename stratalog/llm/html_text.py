"""The main text of web pages, by gradient-boosted trees over DOM elements and a decoding over the tree.

Training. Two bounded sets of labelled pages: `made_pages` pages laid out at random, whose articles are known, with the
article in many kinds of containers and all kinds of other matter around and inside it; and at most `sample_pages` pages of
the input that mark their article with <article> or <main>. Every element is a row.

Decoding. An element is out of the article, in it, or cut out of it. In page-tree order, only out may turn to in, and in to
cut; so no element is in the text below one that was cut. Of all such choices, the one with the greatest sum of log-odds
is taken, elements weighing by their own text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .dom import Page
from .textarrays import freeing

_SYLLABLES = "an be cor da el fi gra hu in jo ka lo mi ne or pe qua ri so ta un ve wi xa yo ze th st ing er on re".split()


class _Maker:
    """Random pages; each block element carries its label in the attribute data-y."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(len(words)):
            if r.random() < 0.1:
                words[k] += r.choice(",.;:")
        return " ".join(words).capitalize() + r.choice([".", ".", "", "!"])

    def attribute(self, *names: str) -> str:
        r = self.r
        if not names or r.random() < 0.25:
            return ""
        return f' {r.choice(["class", "class", "id", "role"])}="{r.choice(names)}{r.choice(["", "", "-inner", " wide", "-1"])}"'

    def links(self, tag: str, low: int, high: int, y: int = 0) -> str:
        return "".join(f'<{tag} data-y="{y}"><a href="/{k}">{self.words(1, 5)}</a></{tag}>' for k in range(self.r.randint(low, high)))

    def paragraph(self, y: int = 1) -> str:
        r = self.r
        text = self.words(*r.choice([(1, 12), (10, 40), (30, 120), (60, 200)]))
        if r.random() < 0.25:
            a, _, b = text.partition(" ")
            text = f'{a} <a href="/x">{self.words(1, 4)}</a> {b}'
        if r.random() < 0.15:
            text = f"<b>{text}<br>"
        return f'<p data-y="{y}">{text}' + ("</p>" if r.random() < 0.85 else "")

    def junk(self) -> str:
        r = self.r
        kind = r.randrange(12)
        w = self.words
        if kind == 0:
            return f'<{(t := r.choice(["nav", "div", "ul"]))}{self.attribute("nav", "menu", "breadcrumb")} data-y="0"><ul data-y="0">{self.links("li", 2, 9)}</ul></{t}>'
        if kind == 1:
            return f'<div{self.attribute("ad", "ads", "advert", "sponsored", "promo")} data-y="0">{w(3, 30)}</div>'
        if kind == 2:
            return f'<{(t := r.choice(["aside", "div"]))}{self.attribute("sidebar", "related", "widget")} data-y="0"><h3 data-y="0">{w(1, 4)}</h3>{self.links("p", 2, 6)}</{t}>'
        if kind == 3:
            replies = "".join(f'<{(t := r.choice(["li", "div"]))}{self.attribute("comment", "reply")} data-y="0"><p data-y="0">{w(1, 3)}</p>{self.paragraph(0)}</{t}>' for _ in range(r.randint(1, 6)))
            return f'<{(t := r.choice(["section", "div"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "replies", "discussion", "comment-list"])}" data-y="0"><h3 data-y="0">{w(1, 3)}</h3>{replies}</{t}>'
        if kind == 4:
            return f'<div{self.attribute("cookie-notice", "notice", "alert", "consent", "newsletter")} data-y="0"><p data-y="0">{w(5, 40)}</p></div>'
        if kind == 5:
            return f'<form{self.attribute("search", "login", "contact")} data-y="0"><p data-y="0">{w(1, 12)}</p><input><button>{w(1, 2)}</button></form>'
        if kind == 6:
            return f'<div{self.attribute("share", "social", "tags")} data-y="0">{self.links("span", 2, 5)}</div>'
        if kind == 7:
            return f'<{(t := r.choice(["footer", "div"]))}{self.attribute("footer", "copyright") if t == "footer" else self.attribute("footer", "site-footer", "copyright") or " class=footer"} data-y="0">&copy; {w(2, 25)}</{t}>'
        if kind == 8:
            return f'<{(t := r.choice(["header", "div"]))}{self.attribute("masthead", "header", "logo") or " id=top"} data-y="0"><p data-y="0">{w(1, 8)}</p>{self.links("p", 0, 3)}</{t}>'
        if kind == 9:
            return f'<aside{self.attribute("promo", "sidebar", "note")} data-y="0">{self.paragraph(0)}</aside>'
        if kind == 10:
            return f'<ul{self.attribute("related", "more", "popular")} data-y="0">{self.links("li", 2, 8)}</ul>'
        return f'<div{self.attribute("sidebar", "widget", "popup", "modal", "banner") or " class=widget"} data-y="0"><h4 data-y="0">{w(1, 4)}</h4><p data-y="0">{w(5, 50)}</p></div>'

    def article(self) -> str:
        r = self.r
        out = [f'<h1 data-y="1">{self.words(2, 14)}</h1>'] if r.random() < 0.85 else []
        if r.random() < 0.1:
            out = [f'<header data-y="1">{out[0]}</header>'] if out else out
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.76:
                out.append(self.paragraph())
            elif kind < 0.82:
                out.append(f'<h2 data-y="1">{self.words(1, 8)}</h2>')
            elif kind < 0.88:
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{self.words(2, 25)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f'<blockquote data-y="1">{self.paragraph()}</blockquote>')
            elif kind < 0.94:
                out.append('<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{self.words(1, 6)}</td><td data-y="1">{self.words(1, 6)}</td></tr>' for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f'<div data-y="1">{self.words(5, 80)}</div>')
            else:
                out.append(self.junk())
        if r.random() < 0.2:
            out.append(self.junk())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag, names = r.choice([("article", ("post", "entry")), ("article", ()), ("main", ("content",)), ("div", ("article", "content", "post-body", "entry-content", "story", "main")), ("section", ("content", "story")), ("div", ())])
        body = f'<{tag}{self.attribute(*names)} data-y="1">{self.article()}</{tag}>'
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = f'<div{self.attribute("container", "wrapper", "page")} data-y="0">{self.junk() if r.random() < 0.4 else ""}{body}{self.junk() if r.random() < 0.4 else ""}</div>'
        top = "".join(self.junk() for _ in range(r.choice([0, 1, 2, 3])))
        low = "".join(self.junk() for _ in range(r.choice([0, 1, 2, 3])))
        return f'<html><body data-y="0">{top}{body}{low}</body></html>'


def _examples(page: Page) -> list[int]:
    """The elements' labels; one without any takes its parent's."""
    out: list[int] = []
    for k, label in enumerate(page.label):
        out.append(label if label is not None else out[page.parent[k]] if k else 0)
    return out


def _marked(page: Page) -> list[int] | None:
    """Labels from the page's own <article> or <main>, None where it has none; navigation, forms and the like in it are out."""
    roots = [k for k, t in enumerate(page.tag) if t == "article"] or [k for k, t in enumerate(page.tag) if t == "main"]
    if not roots:
        return None
    out: list[int] = []
    for k, tag in enumerate(page.tag):
        above = out[page.parent[k]] if k else 0
        out.append(1 if k in roots else int(above and tag not in ("nav", "aside", "footer", "form") and not page.groups[k] & 0b0001011111))
    return out


def train(sample: list[str], made_pages: int = 900, seed: int = 11) -> Trees:
    """Trees from made_pages random pages and the sample's pages that mark their article."""
    maker = _Maker(seed)
    rows, labels = [], []
    made = [Page(maker.page(), labelled=True) for _ in range(made_pages)]
    for page in [*made, *map(Page, sample)]:
        found = _examples(page) if page.labelled else _marked(page)
        if found is not None:
            rows.append(page.features())
            labels.append(np.array(found))
    x, y = np.concatenate(rows), np.concatenate(labels)
    return fit(x, y, np.ones(len(y)))


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """Which elements are in the article."""
    n = len(page.tag)
    own = [0] * n
    for k, text in page.blocks:
        own[k] += len(text)
    gain = [float(np.clip(logits[k], -6, 6)) * (0.3 + own[k] ** 0.5 / 10) for k in range(n)]
    out, inside, cut = [-g for g in gain], gain[:], [-g for g in gain]
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        out[p] += max(out[k], inside[k])
        inside[p] += max(inside[k], cut[k])
        cut[p] += cut[k]
    state = ["in" if inside[0] > out[0] else "out"]
    for k in range(1, n):
        above = state[page.parent[k]]
        if above == "out":
            state.append("in" if inside[k] > out[k] else "out")
        elif above == "in":
            state.append("in" if inside[k] >= cut[k] else "cut")
        else:
            state.append("cut")
    return [s == "in" for s in state]


def extract(pages: list[str], trees: Trees) -> list[str]:
    """Each page's main text: its blocks, with two line ends between."""
    read = [Page(html) for html in pages]
    rows = [p.features() for p in read]
    logits = trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, r in zip(read, rows, strict=True):
        chosen = decode(page, logits[at : at + len(r)])
        at += len(r)
        out.append("\n\n".join(text for k, text in page.blocks if chosen[k]))
    return out


def main_text(pages: DataFrame, sample_pages: int = 200, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points).

    A null or empty page has an empty text, and so has one without an article. Rows that repeat are read apart. An empty
    table gives an empty one. Other columns are ignored. Only the training sample is bounded; every page is read whole.
    """
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    total = source.count()
    share, mark = max(1, total // (2 * sample_pages)), F.xxhash64("page_id", "url")
    sample = source.where(F.pmod(mark, F.lit(share)) == 0).where(F.octet_length("html").between(1, 100_000)).orderBy(mark, "html").select("html").limit(sample_pages)
    trees = train([r["html"] for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = extract([h or "" for h in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(source.dtypes)
    return source.mapInArrow(freeing(run), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
