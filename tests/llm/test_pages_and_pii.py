"""Main text and PII."""

import collections
import math
import random
import re
import time

import edge

import __spark_entry__
from stratalog.llm.dom import NAMES, Page
from stratalog.llm.html_text import _examples, _Maker, decode, extract, main_text, train
from stratalog.llm.pii import as_text, find_pii, redacted
from stratalog.llm.queries import QUERIES, SQL


def test_held_out_pages():
    trees, maker, exact = train([], made_pages=500), _Maker(12345), 0
    for _ in range(150):
        page = Page(maker.page(), labelled=True)
        y, chosen = _examples(page), decode(page, trees.logits(page.features()))
        assert all(not chosen[k] or chosen[page.parent[k]] or not any(chosen[a] for a in ancestors(page, k)) for k in range(len(page.tag)))
        exact += all(bool(y[k]) == chosen[k] for k, _ in page.blocks)
    assert exact >= 120


class _Scanning(Page):
    """Closes elements by going through all that are open."""

    def _pop(self, stack, open_at, names, walls):
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                cut = k
            elif self.tag[stack[k]] in walls:
                break
        if cut is not None:
            self._close(stack, open_at, cut)


def test_elements_are_closed_as_by_going_through_the_open_ones():
    r = random.Random(12)
    names = "p div ul li dl dt dd table tr td tbody h1 section option form blockquote".split()
    for _ in range(300):
        soup = "".join(r.choice(["<{}>", "<{}>", "</{}>", "x<{}>"]).format(r.choice(names)) for _ in range(r.choice([5, 40, 120])))
        fast, slow = Page(soup), _Scanning(soup)
        assert (fast.tag, fast.parent, fast.blocks) == (slow.tag, slow.parent, slow.blocks)


def test_deep_pages_take_time_in_proportion():
    def seconds(n):
        began = time.monotonic()
        page = Page("<div>" * n + "<p>text" * 50 + "</div>" * n)
        page.features()
        return time.monotonic() - began, len(page.tag)

    (few, _), (many, n) = seconds(10_000), seconds(100_000)
    assert n == 100_051 and many < 30 * few + 1


def test_sibling_places_in_long_containers():
    page = Page("<body><h1>t</h1><div>" + "".join(f"<p>{'x' * k}</p>" for k in range(1, 101)) + "</div>")
    rows = {k: dict(zip(NAMES, row, strict=True)) for k, row in enumerate(page.features())}
    texts = [rows[k] for k in rows if page.tag[k] == "p"]
    assert [round(t["sibling_place"] * 100) for t in texts] == list(range(100)) and {t["same_siblings"] for t in texts} == {100}
    assert [round(math.expm1(t["next_text"])) for t in texts[:-1]] == list(range(2, 101)) and texts[-1]["next_text"] == -1
    assert [round(math.expm1(t["previous_text"])) for t in texts[1:]] == list(range(1, 100)) and texts[0]["previous_text"] == -1


def ancestors(page, k):
    while (k := page.parent[k]) >= 0:
        yield k


#: Pages written by hand, each with its article's text.
WRITTEN = [
    (
        """<!DOCTYPE html><html><head><title>Tides | The Harbour Post</title><style>p { margin: 0 }</style></head><body>
<header class="masthead"><a href="/">The Harbour Post</a></header>
<nav><ul><li><a href="/n">News</a></li><li><a href="/w">Weather</a></li><li><a href="/s">Sport</a></li></ul></nav>
<main><article class="post"><h1>Why the spring tide came early</h1>
<p>Fishermen along the coast were caught unprepared on Tuesday, when the water rose almost an hour before the time that
the tables had given. &ldquo;I have not seen this in thirty years,&rdquo; said one of them.</p>
<p>The level <math><mi>h</mi></math> depends on the moon, on the wind and on the pressure of the air, and all three
played a part this time, the harbour office wrote in its report on the next day.</p>
<aside class="advert"><p>Buy new boots now!</p></aside>
<h2>What comes next</h2>
<p>New tables are due in March. Until then, boats should leave the inner basin two hours before high water at the latest.</p></article></main>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>anna: Same here in the north, we lost a net.</p></div><div class="comment"><p>bert: The tables are useless.</p></div></section>
<footer>&copy; 2024 The Harbour Post. <a href="/imprint">Imprint</a></footer><script>track("tides");</script></body></html>""",
        [
            "Why the spring tide came early",
            "Fishermen along the coast were caught unprepared on Tuesday, when the water rose almost an hour before the time that the tables had given. \u201cI have not seen this in thirty years,\u201d said one of them.",
            "The level h depends on the moon, on the wind and on the pressure of the air, and all three played a part this time, the harbour office wrote in its report on the next day.",
            "What comes next",
            "New tables are due in March. Until then, boats should leave the inner basin two hours before high water at the latest.",
        ],
    ),
    (
        """<body><div id="top" class="header"><p>Garden notes</p></div><div class="menu"><ul><li><a href=/a>Home</a><li><a href=/b>Plants</a><li><a href=/c>About</a></ul></div>
<div class="cookie-notice"><p>We use cookies to make this site better. Accept?</p></div>
<div class="content"><h1>Moving an old rose</h1><p>Dig in late autumn, when the leaves have fallen, and keep as much of the root as you can carry in one piece.
<p>Cut the shoots back to a hand's breadth. It looks harsh, but the plant has fewer roots to feed them with, and it will thank you in the summer.
<ul><li>a sharp spade<li>a bucket of water<li>compost, well rotted</ul>
<p>Water well, and then leave it alone until spring.</div>
<div class="sidebar"><h3>Popular</h3><p><a href=/p>Ten easy shrubs</a><p><a href=/q>Slugs</a></div><div class="footer">Garden notes, since 2009</div></body>""",
        [
            "Moving an old rose",
            "Dig in late autumn, when the leaves have fallen, and keep as much of the root as you can carry in one piece.",
            "Cut the shoots back to a hand's breadth. It looks harsh, but the plant has fewer roots to feed them with, and it will thank you in the summer.",
            "a sharp spade",
            "a bucket of water",
            "compost, well rotted",
            "Water well, and then leave it alone until spring.",
        ],
    ),
]


def test_pages_written_by_hand():
    trees = train([])
    got = extract([html for html, _ in WRITTEN], trees)
    assert [t.split("\n\n") for t in got] == [want for _, want in WRITTEN]
    assert all(x is None for x in Page('<div data-y="3"><article data-y="0">x</article></div>').label)


def test_a_page_of_many_siblings():
    page = "<body><article>" + "".join(f"<p>Paragraph {k} of a very long article.</p>" for k in range(100_000)) + "</article></body>"
    began = time.monotonic()
    assert extract([page], train([], made_pages=300))[0].count("\n\n") == 99_999
    assert time.monotonic() - began < 60


def test_page_reading(spark):
    trees = train([], made_pages=300)
    html = '<body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two\n\n three<br>four<p>Five &lt;6&gt;</article><script>var x="</p>";</script><footer>&copy; me</footer>'
    assert extract([html, "", "<", "<p", "<!-- x"], trees)[0] == "A & B\n\nOne two three four\n\nFive <6>"
    rows = [(1, "u", html, "x"), (2, None, None, "x"), (2, None, "", "x"), (None, "u", "<" * 2000, "x")]
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 4 and {r.page_id: r.n_chars for r in out}[1] == 35 and all(r.text == "" for r in out if r.page_id == 2)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


FORMS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in FORMS.items() for m in re.finditer(p, text or "") if ok(m.group()))


def test_base_forms(spark):
    r = random.Random(3)
    parts = ["a@b.c", "@", ".", "+", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "1.2.3.4", ".5", "256.1.1.1", "+1 (803) 555-5351", "(", "x", "é", "\U0001f600", " ", "\n", "-", "_", "%", "0001.2.3.4", "4111111111111112", "555-1234567"]
    rows = [(k, "".join(r.choices(parts, k=r.randint(0, 14)))) for k in range(1200)] + [(9000, None), (9001, ""), (9002, "a" * 20000), (9003, "1" * 20000), (9004, "a." * 9000 + "@b" + ".c" * 9000)]
    rows.append(rows[5])
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", as_text("base").alias("base")).collect()
    assert sorted((r.doc_id, r.base) for r in found) == sorted((d, base_spans(t)) for d, t in rows)
    assert find_pii(edge.nothing(spark)).count() == 0


def test_contexts_reveal_other_identifiers(spark):
    r = random.Random(6)
    filler = lambda: " ".join(r.choices(edge.WORDS, k=12))
    rows = [(k, f"{filler()} Call me: +1 (803) 555-{1000 + k} {filler()}") for k in range(20)]
    rows += [(100, f"{filler()} call me: 803-555-7777 {filler()}"), (101, f"{filler()} order of 803-555-8888 {filler()}")]
    found = {x.doc_id: x for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[20][1].index("803")
    assert [tuple(s) for s in found[100].spans] == [("phone", at, at + 12)] and not found[101].spans
    assert all(found[k].spans == found[k].base and len(found[k].base) == 1 for k in range(20))


def test_a_context_is_learnt_in_any_number_of_seeds(spark):
    rows = [(k, f"w{k} v{k} +1 (803) 555-{1000 + k} end") for k in range(1200)]
    rows += [(2000 + k, f"please ring bob: +1 (803) 556-{1000 + k} end") for k in range(3)] + [(3000, "please ring bob: 803-555-7777 end"), (3001, "please ring ann: 803-555-7777 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in find_pii(docs).collect()}
    assert len(found) == len(rows) and [tuple(s) for s in found[3000].spans] == [("phone", 17, 29)] and not found[3001].spans
    assert all(len(found[k].spans) == 1 for k in range(1200))
    assert {r.text for r in redacted(docs).where("doc_id >= 3000").collect()} == {"please ring bob: <PHONE> end", rows[-1][1]}


def test_copies_do_not_weaken_a_context(spark):
    rows = [(k, f"so call me: +1 (803) 555-{1000 + k % 4} end") for k in range(60)] + [(100, "so call me: 803-555-7777 end")]
    rows += [(200 + k, f"a number: +1 (803) 556-{1000 + k} end") for k in range(4)] + [(300 + k, "a number: none") for k in range(20)] + [(400, "a number: 803-555-7777 end")]
    found = {x.doc_id: x for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[100].spans] == [("phone", 12, 24)] and not found[400].spans


def test_loose_forms_in_any_text_and_layout(spark):
    wide = " " * 300
    rows = [(k, f"so send me: bob{k}@mx.com ok") for k in range(8)] + [(100, "so send me: joe @ mx.com ok"), (101, "so send me: joe@localhost ok"), (102, "so send me: joe(at)mx.com ok")]
    rows += [(200 + k, f"{'x' * 150} {'y' * 150}: {wide}+1 (803) 555-{1000 + k} ok") for k in range(8)] + [(300, f"{'x' * 150} {'y' * 150}: {wide}803-555-7777 ok"), (301, f"{'z' * 150} {'y' * 150}: {wide}803-555-7777 ok")]
    found = {x.doc_id: as_tuples(x.spans) for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k in (100, 101, 102)] == [[("email", 12, 24)], [("email", 12, 25)], [("email", 12, 25)]]
    assert found[300] == [("phone", 603, 615)] and not found[301]


def brute_patterns(rows, seeds=3, confidence=0.6):
    """The accepted patterns for phone numbers in texts of the form `two words: number rest`, by counting in plain loops."""
    seen = [(m.group(1).lower(), m.group(2)) for _, t in rows for m in re.finditer(r"(\S+ \S+) (\+?[0-9][0-9() -]+[0-9])", t)]
    stands = collections.Counter(" ".join(w) for _, t in rows for w in zip(t.lower().split(), t.lower().split()[1:], strict=False))
    score = {x: 1.0 for _, x in seen if x.startswith("+")}
    accepted = {}
    while True:
        now = {}
        for left in {p for p, _ in seen}:
            after = [x for p, x in seen if p == left]
            if len({x for x in after if x in score}) >= seeds and sum(score.get(x, 0) for x in after) / stands[left] >= confidence:
                now[left] = sum(score.get(x, 0) for x in after) / stands[left]
        if len(now) == len(accepted):
            return now
        accepted = now
        for p, x in seen:
            if p in now and not x.startswith("+"):
                score[x] = max(score.get(x, 0), now[p])


def test_found_identifiers_induce_new_patterns(spark):
    rows = [(k, f"so call me: +1 (803) 555-{1000 + k} end") for k in range(12)]
    rows += [(100 + k, f"so call me: 803-556-{1000 + k} end") for k in range(4)]  # found in round 1
    rows += [(200 + k, f"desk fax: 803-556-{1000 + k} end") for k in range(4)] + [(300, "desk fax: 803-557-7777 end")]  # known then, so the context is learnt
    rows += [(400 + k, f"batch no: 803-558-{1000 + k} end") for k in range(6)] + [(500 + k, f"desk lamp: 803-556-{1000 + k} end") for k in range(2)]
    want = brute_patterns(rows)
    assert {"call me:", "desk fax:"} <= set(want) and "batch no:" not in want and "desk lamp:" not in want
    found = {x.doc_id: as_tuples(x.spans) for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        marked = "+" in t or any(f"{p} " in t for p in want)
        assert found[d] == ([("phone", re.search(r"[+8]", t).start(), len(t) - 4)] if marked else []), t


def test_planted_contexts_are_recalled(spark):
    r = random.Random(11)
    leads = [f"{r.choice(edge.WORDS)} {x}:" for x in ("phone", "hotline", "reach me", "tel", "callback")]
    filler = lambda: " ".join(r.choices(edge.WORDS, k=15))
    rows = [(k, f"{filler()} {leads[k % 5]} +1 (803) 555-{1000 + k} {filler()}") for k in range(60)]
    hidden = [(1000 + k, f"{filler()} {leads[k % 5]} {r.choice(['803-555-', '(803) 555 ', '803.555.'])}{5000 + k} {filler()}") for k in range(30)]
    clean = [(2000 + k, f"{filler()} order {r.choice(edge.WORDS)} 803-555-{7000 + k} {filler()}") for k in range(30)]
    found = {x.doc_id: len(x.spans) for x in find_pii(spark.createDataFrame(rows + hidden + clean, "doc_id long, text string")).collect()}
    assert sum(found[d] == 1 for d, _ in hidden) >= 0.9 * len(hidden) and not any(found[d] for d, _ in clean)


def as_tuples(spans):
    return [tuple(s) for s in spans]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é a@b.cd, 1.2.3.4 end", "k"), (2, None, "k"), (2, "clean", "k")], "doc_id long, text string, key string")
    assert sorted(tuple(r) for r in redacted(docs).where("text is not null").collect()) == [(1, "mail é <EMAIL>, <IP> end", "k"), (2, "clean", "k")]
    assert redacted(docs).columns == docs.columns and redacted(docs).count() == 3


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [n for n in QUERIES if re.match(r"op\d+_", n)] == list(QUERIES) and len(QUERIES) == 13 and set(SQL) <= set(QUERIES) and set(QUERIES) <= set(names)
