"""Main-text extraction with a tree-structured graphical model over the DOM.

Each block element is in one of four states: frame (holds content and other things), content, the outermost element of
a piece of boilerplate, or one inside it (always so below the outermost). States
depend on each other only along parent-child edges; an element's tag with the share of its text in links, the known words of
its class, id and role, the amount of its text and its parent's tag depend on its own state. Messages go from the leaves to the root and
back (sum-product), which gives every element's exact marginals; text whose element is less likely in boilerplate
than not is kept. All tables are counts over labelled pages, smoothed; by default the pages are those of `labelled_pages`,
written from a grammar of common layouts with a state named on the elements where it changes.

Defined cases: null and empty pages give an empty text; an unfinished tag at the end is no text; a page without any
element is all content; unclosed elements end where their parent does; repeated rows are read each; an empty table
gives no rows; further columns are ignored. Nothing is cut off or capped.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

RESULT = "page_id long, url string, text string, n_chars long"
FRAME, CONTENT, BOILERPLATE, INNER = range(4)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag ends an open element of these, unless one of the second kind was opened since.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, set()),
}
#: Words of class, id and role that layouts are commonly named by.
_KNOWN = frozenset(
    """ad ads advert advertisement alert article author banner body bottom breadcrumb button byline caption comment comments content contact
    cookie consent copyright disqus entry feedback footer form header hero latest legal links list login logo main masthead menu meta modal more
    nav navigation navbar newsletter notice page pagination partner podcast popular popup post primary promo recommended related reply
    response responses search share sidebar signup site skip social sponsor sponsored story subscribe tags teaser text title toolbar top
    topbar trending widget wrapper container reader readers discussion complementary contentinfo aside warning gdpr rail""".split()
)
_TOP = {"#page": "body", "html": "body"}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_LABEL = re.compile(r"""data-state=["']?(\d)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block elements in page order (parents first) and the runs of text between their tags."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.label = [-1], ["#page"], [()], [None]
        self.text = [0]
        self.linked = [0]
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        names: tuple = ("-",)
        if attributes and "=" in attributes:
            found = {w.lower() for x in _NAMES.findall(attributes) for w in _WORD.findall(x)}
            names = tuple(sorted(found & _KNOWN)) or ("-",)
            label = _LABEL.search(attributes)
        else:
            label = None
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(int(label[1]) if label else None)
        self.text.append(0)
        self.linked.append(0)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, inline ones with their block's number
        open_p = links = at = 0
        held: list[str] = []

        def flush() -> None:
            run = " ".join("".join(held).split())
            if run:
                self.runs.append((stack[-1][1], run))
            held.clear()

        def said(piece: str) -> None:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            n, k = len(piece), stack[-1][1]
            self.text[k] += n
            if links:
                self.linked[k] += n

        def close(to: int) -> None:
            nonlocal links, open_p
            if any(t not in _INLINE for t, _ in stack[to:]):
                flush()
            for t, _ in stack[to:]:
                links -= t == "a"
                open_p -= t == "p"
            del stack[to:]

        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            begin = m.start() if m else end
            if begin > at:
                said(source[at:begin])
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "br" or tag == "p" and not open_p:
                    held.append(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        break  # an inline end tag doesn't end blocks
                continue
            if tag in _VOID:
                if tag not in ("wbr", "link", "meta"):
                    held.append(" ")
                continue
            if tag in _RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag in _INLINE:
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
                continue
            if open_p and tag in _CLOSES_P:
                close(max(k for k, (t, _) in enumerate(stack) if t == "p"))
            if tag in _ENDS:
                ended, bounds = _ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        close(k)
                        break
                    if stack[k][0] in bounds:
                        break
            flush()
            stack.append((tag, self._add(stack[-1][1], tag, m[3] or m[6] or "")))
            open_p += tag == "p"
        flush()

    def observed(self) -> list[tuple]:
        """What is seen of each element: tag and share of text in links, known names, amount of text (its own and below), parent's tag."""
        text, linked = self.text[:], self.linked[:]
        for k in range(len(text) - 1, 0, -1):
            text[self.parent[k]] += text[k]
            linked[self.parent[k]] += linked[k]
        return [
            ((t, 0 if not b else 1 if 5 * b < a else 2 if 2 * b < a else 3), n, 0 if a < 2 else 1 if a < 25 else 2 if a < 80 else 3 if a < 250 else 4, _TOP.get(self.tag[p], self.tag[p]))
            for t, n, a, b, p in zip(self.tag, self.names, text, linked, self.parent, strict=True)
        ]

    def labels(self) -> list[int]:
        out: list[int] = []
        for k, own in enumerate(self.label):
            above = out[self.parent[k]] if k else FRAME
            out.append(INNER if above >= BOILERPLATE else above if own is None else own)
        return out


class Model:
    """Counts of labelled pages as potentials."""

    def __init__(self, pages: list[str]):
        edges = [[1.0, 1.0, 1.0, 0.0], [1.0, 1.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0]]
        self.seen = [1.0] * 4
        parts: list[list[Counter]] = [[Counter() for _ in range(4)] for _ in range(4)]
        for source in pages:
            page = Page(source)
            y = page.labels()
            for k, (what, state) in enumerate(zip(page.observed(), y, strict=True)):
                if k:
                    edges[y[page.parent[k]]][state] += 1
                self.seen[state] += 1
                parts[state][0][what[0]] += 1
                parts[state][1].update(what[1])
                parts[state][2][what[2]] += 1
                parts[state][3][what[3]] += 1
        self.edges = [[x / sum(row) for x in row] for row in edges]
        self.parts = parts
        self.tags = len({t for p in parts for t in p[0]}) + 1
        self.known: dict[tuple, tuple[float, ...]] = {}

    def seen_as(self, what: tuple) -> tuple[float, ...]:
        """How likely each state shows this."""
        got = self.known.get(what)
        if got is None:
            out = []
            for s in range(4):
                n, (tags, names, amounts, above) = self.seen[s], self.parts[s]
                p = (tags[what[0]] + 0.05) / (n + 0.05 * self.tags)
                for w in what[1]:
                    p *= (names[w] + 0.2) / (n + 1)
                out.append(p * (amounts[what[2]] + 0.5) / (n + 2.5) * (above[what[3]] + 0.5) / (n + 0.5 * self.tags))
            total = sum(out)
            got = tuple(x / total for x in out)
            if len(self.known) < 200_000:
                self.known[what] = got
        return got

    def marginals(self, page: Page) -> list[tuple[float, ...]]:
        """Every element's probabilities of the four states, the page itself being a frame."""
        (f0, f1, f2, _), (c0, c1, c2, _) = self.edges[:2]  # below boilerplate, everything is inside it
        parent, n = page.parent, len(page.parent)
        up = [list(self.seen_as(x)) for x in page.observed()]
        up[0] = [1.0, 0.0, 0.0, 0.0]
        sent: list[tuple[float, ...]] = [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b, c, d = up[k]
            x, y, z = f0 * a + f1 * b + f2 * c, c0 * a + c1 * b + c2 * c, d
            s = x + y + z or 1.0
            # Never quite 0, as messages are divided out again on the way down.
            sent[k] = x, y, z = x / s or 1e-200, y / s or 1e-200, z / s or 1e-200
            p = up[parent[k]]
            p[0] *= x
            p[1] *= y
            p[2] *= z
            p[3] *= z
            if p[0] + p[1] + p[2] + p[3] < 1e-100:  # many children; only proportions matter
                s = max(p)
                up[parent[k]] = [v / s for v in p] if s > 0 else [1.0, 1.0, 1.0, 1.0]
        out: list[tuple[float, ...]] = [(1.0, 0.0, 0.0, 0.0)] * n
        for k in range(1, n):
            # The parent's belief without what this child sent, through the edge, times the child's own.
            q, m, (a, b, c, d) = out[parent[k]], sent[k], up[k]
            x, y, z = q[0] / m[0], q[1] / m[1], (q[2] + q[3]) / m[2]
            a, b, c, d = a * (f0 * x + c0 * y), b * (f1 * x + c1 * y), c * (f2 * x + c2 * y), d * z
            s = a + b + c + d
            out[k] = (a / s, b / s, c / s, d / s) if s > 0 else q
        return out

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        states = self.marginals(page)
        return " ".join(run for k, run in page.runs if states[k][BOILERPLATE] + states[k][INNER] < 0.5)


def labelled_pages(number: int = 1000, seed: int = 7) -> list[str]:
    """Pages of common layouts; data-state names an element's state (0 frame, 1 content, 2 boilerplate), which those below share."""
    r = random.Random(seed)
    pick = r.choice

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/x">{words(a, b)}</a>'

    def named(*options: str) -> str:
        x = pick(options)
        return pick([f'class="{x}"', f'id="{x}"', f'class="{x} {pick(["box", "clearfix", "row", "inner"])}"', f'class="site-{x}"'])

    def items(n: int) -> str:
        return f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(n))}</ul>"

    def menu() -> str:
        inner = items(r.randint(3, 8))
        return pick([f"<nav data-state=2>{inner}</nav>", f'<div data-state=2 {named("nav", "menu", "navigation", "navbar", "breadcrumb", "topbar")}>{inner}</div>', f'<ul data-state=2 {named("menu", "nav", "breadcrumb")}>{"".join(f"<li>{link()}</li>" for _ in range(4))}</ul>'])

    def header() -> str:
        inner = pick([link() + items(4), f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>", f"<div class=logo>{link()}</div>", f"<p>{words(1, 6)}</p>{menu()}"])
        return pick([f"<header data-state=2>{inner}</header>", f'<div data-state=2 {named("header", "masthead", "topbar", "banner", "hero")}>{inner}</div>'])

    def footer() -> str:
        inner = pick([f"&copy; {words(1, 4)} &middot; {words(3, 12)}", f"<p>{words(4, 20)}</p>", items(4), f"<p>{words(2, 6)} {link()}</p><div>{words(4, 30)}</div>"])
        return pick([f"<footer data-state=2>{inner}</footer>", f'<div data-state=2 {named("footer", "bottom", "copyright", "contentinfo", "legal")}>{inner}</div>'])

    def advert() -> str:
        inner = pick([words(3, 25), f"<p>{words(3, 40)}</p>", link(3, 9), f"<p>{words(2, 9)}</p>{link()}"])
        return f'<{pick(["div", "div", "section", "p", "aside"])} data-state=2 {named("ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "sponsor", "partner")}>{inner}'

    def ended(x: str) -> str:
        return f"{x}</{re.match('<([a-z]+)', x)[1]}>"

    def notice() -> str:
        inner = pick([words(5, 30), f"<p>{words(5, 40)}</p><button>{words(1, 2)}</button>", f"<p>{words(4, 25)} {link()}</p>"])
        return f'<div data-state=2 {named("notice", "cookie", "cookie-notice", "consent", "alert", "popup", "modal", "gdpr", "cookie-banner", "warning")}>{inner}</div>'

    def sidebar() -> str:
        inner = pick([f"<h3>{words(1, 3)}</h3>{items(5)}", f"<p>{words(5, 50)}</p>", f"<h2>{words(1, 3)}</h2><p>{words(5, 40)}</p>{items(3)}", f"<div class=widget><p>{words(5, 30)}</p></div>"])
        return pick([f"<aside data-state=2>{inner}</aside>", f'<aside data-state=2 {named("sidebar", "related", "rail")}>{inner}</aside>', f'<div data-state=2 {named("sidebar", "related", "recommended", "popular", "widget", "trending", "complementary", "latest", "links", "social", "share", "tags", "newsletter", "subscribe")}>{inner}</div>'])

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=q><p>{words(2, 14)}</p><button>{words(1, 2)}</button>"
        return pick([f"<form data-state=2>{inner}</form>", f'<form data-state=2 {named("search", "login", "signup", "subscribe", "form", "feedback", "newsletter", "contact")}>{inner}</form>', f'<div data-state=2 {named("search", "login", "signup", "contact")}><form>{inner}</form></div>'])

    def comments() -> str:
        one = lambda: f'<{pick(["div", "div", "li", "li", "li", "article"])} class="{pick(["comment", "comment-body", "reply", "response"])}"><p>{words(4, 60)}</p>'
        inner = f"<h3>{words(1, 3)}</h3>" + "".join(ended(one()) for _ in range(r.randint(1, 6)))
        return f'<{(t := pick(["div", "section", "section", "ol"]))} data-state=2 {named("comments", "comment-list", "responses", "discussion", "disqus", "reader-comments", "feedback")}>{inner}</{t}>'

    def paragraph() -> str:
        x = words(*pick([(1, 6), (10, 40), (20, 90), (40, 160)]))
        kind = r.random()
        if kind < 0.68:
            return f"<p>{x}</p>" if r.random() < 0.8 else f"<p>{x} {link()} {words(3, 20)}</p>"
        if kind < 0.78:
            return f"<h{r.randint(2, 4)}>{words(1, 8)}</h2>"
        return pick([f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(4))}</ul>", f"<blockquote>{x}</blockquote>", f"<pre>{x}</pre>", f"<div>{x}</div>", f"<section><h2>{words(1, 5)}</h2><p>{x}</p></section>", f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 9)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(3, 12)}</figcaption></figure>", f"<ol><li>{words(3, 20)}</li></ol>", f"<dl><dt>{words(1, 3)}</dt><dd>{words(3, 20)}</dd></dl>", f"<p><b>{x}<br>"])

    def article() -> str:
        title = pick([f"<h1>{words(2, 9)}</h1>", f"<header><h1>{words(2, 9)}</h1></header>", f'<h2 class="{pick(["title", "entry-title", "post-title"])}">{words(2, 9)}</h2>', f"<h1>{words(2, 9)}</h1><p class=byline>{words(2, 5)}</p>", ""])
        body = [paragraph() for _ in range(r.randint(1, 12))]
        for extra in (lambda: ended(advert()), sidebar, comments, form, notice):
            if r.random() < 0.2:
                body.insert(r.randint(0, len(body)), extra())
        inner = title + "".join(body)
        if r.random() < 0.2:
            inner = f'<div class="{pick(["body", "text", "entry", "content"])}">{inner}</div>'
        tag = pick(["article", "article", "main", "div", "section", "td"])
        if tag in ("div", "section"):
            return f'<{tag} data-state=1 {named("content", "article", "post", "entry", "story", "main", "text", "post-body", "article-body", "main-content", "entry-content", "page-content")}>{inner}</{tag}>'
        return f"<{tag} data-state=1>{inner}</{tag}>" if tag != "td" else f"<table data-state=0><tr><td data-state=1>{inner}</td></tr></table>"

    out = []
    for _ in range(number):
        parts = [x for chance, x in ((0.7, header), (0.8, menu), (0.3, notice), (0.4, lambda: ended(advert())), (0.2, form)) if r.random() < chance for x in [x()]]
        core = article() if r.random() < 0.9 else "".join(re.sub(r"^<(\w+)", r"<\1 data-state=1", paragraph()) for _ in range(r.randint(2, 9)))
        after = [x for chance, x in ((0.4, sidebar), (0.35, comments), (0.3, lambda: ended(advert())), (0.2, form), (0.2, menu)) if r.random() < chance for x in [x()]]
        middle = core + "".join(after)
        if r.random() < 0.4:
            middle = f'<div {named("wrapper", "container", "page", "main")}>{middle}</div>'
        body = "".join(parts) + middle + (footer() if r.random() < 0.85 else "")
        if r.random() < 0.2:
            body = f"<div id=page>{body}</div>"
        out.append(body if r.random() < 0.1 else f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return out


_models: list[Model] = []


def default_model() -> Model:
    if not _models:
        _models.append(Model(labelled_pages()))
    return _models[0]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """RESULT for every row of pages (page_id, url, html)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            text = [model.extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, RESULT)
