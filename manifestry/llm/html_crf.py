"""HTML main text by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags).  Each has features from its ancestors'
tags, their class and id words, and its text; the CRF labels the chain of blocks main text or not, decoded by
Viterbi.  It is trained on pages that ``labelled_pages`` writes from templates, whose labels are known.

A null or empty page has the empty text; repeated rows are extracted alike; an empty table gives an empty result;
other columns are not read.  Unclosed or stray tags, and a < that opens no tag, are read as browsers would.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Tags that end a run of text; all others are inline.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section select
summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("hr br img input meta link".split())
#: An open element of the first kind is closed by a start tag of the second.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: What follows a tag's name: quotes count after a = only, and a tag that is never closed reaches to the end, so
#: that the time to read a page grows with its length whatever it holds.
_INSIDE = r"((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)"
#: What follows <svg up to its own />; the slash that ends an unquoted value belongs to the value.
_SELF_CLOSED = r"(?<=<svg)(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)|/(?!>)|[^>/])*+/>"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:-->|\Z))|<(script|style|noscript|template|svg|xmp)(?=[\s/>])(?:{_SELF_CLOSED}|{_INSIDE}.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_INSIDE}",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Words of class, id and role that speak against main text, and for it.
AGAINST = frozenset("""ad ads adv advert advertisement banner promo promotion sponsor sponsored comment comments reply replies respond discussion
cookie cookies consent gdpr sidebar side nav navigation navbar menu footer foot header masthead share sharing social related recommended popup
modal overlay newsletter subscribe signup login breadcrumb breadcrumbs widget notice alert notification disclaimer legal copyright toolbar
pagination pager rating form search contentinfo complementary tags meta byline""".split())
FOR = frozenset("article content post entry main story text prose".split())


@dataclass(frozen=True)
class Open:
    """An open element and what its ancestors add up to, so that depth costs nothing."""

    tag: str
    tags: frozenset  # its own and its ancestors'
    against: bool  # a word of class, id or role of any of them is in AGAINST
    main: bool  # or in FOR


@dataclass(frozen=True)
class Block:
    text: str
    inside: Open | None  # the innermost open element
    linked: float  # share of the text inside links


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, character references decoded and white space made single."""
    out: list[Block] = []
    stack: list[Open] = []
    is_open: Counter = Counter()
    text: list[str] = []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1] if stack else None, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def read(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if in_link:
                linked += len(part.strip())

    at = 0
    for m in TOKEN.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        tag = m[4]
        if tag is None:
            if m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                in_link = not m[3]
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        in_link = False
        if m[3]:
            while is_open[tag]:
                top = stack.pop().tag
                is_open[top] -= 1
                if top == tag:
                    break
        elif tag not in VOID:
            while stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
                is_open[stack.pop().tag] -= 1
            words = {w for a in ATTRIBUTE.finditer(m[5]) for w in WORD.findall((a[1] or a[2] or a[3] or "").lower())}
            up = stack[-1] if stack else Open("", frozenset(), False, False)
            stack.append(Open(tag, up.tags if tag in up.tags else up.tags | {tag}, up.against or not AGAINST.isdisjoint(words), up.main or not FOR.isdisjoint(words)))
            is_open[tag] += 1
    read(page[at:])
    flush()
    return out


def block_features(b: Block) -> list[str]:
    n = b.text.count(" ") + 1
    at = b.inside or Open("none", frozenset(), False, False)
    out = ["bias", "own=" + at.tag, "words=" + ("1" if n < 4 else "4" if n < 11 else "11" if n < 26 else "26"), "links=" + ("0" if b.linked == 0 else "some" if b.linked < 0.5 else "most")]
    out += ["in=" + t for t in sorted(at.tags) if t not in ("html", "body")]
    if at.against:
        out.append("against")
    if at.main:
        out.append("for")
    if b.text[-1] in ".!?…\"'”»":
        out.append("sentence")
    if "©" in b.text:
        out.append("copyright")
    return out


@dataclass(frozen=True)
class Crf:
    """Weights of label 1 (against 0) for each feature, and of the four transitions."""

    weight: dict
    step: tuple  # step[a][b]: from label a to b

    def emissions(self, chain: list[list[str]]) -> list[float]:
        of = self.weight.get
        return [sum(of(f, 0.0) for f in fs) for fs in chain]

    def decode(self, chain: list[list[str]]) -> list[int]:
        """Viterbi; on a tie, label 1 (text is rather kept)."""
        if not chain:
            return []
        (aa, ab), (ba, bb) = self.step
        back, zero, one = [], 0.0, 0.0
        for i, e in enumerate(self.emissions(chain)):
            if i == 0:
                zero, one = 0.0, e
                continue
            to0, to1 = (0 if zero + aa > one + ba else 1), (0 if zero + ab > one + bb else 1)
            back.append((to0, to1))
            zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + e
        label = int(one >= zero)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def fit(chains: list[tuple[list[list[str]], list[int]]], rounds: int = 40, rate: float = 0.5, l2: float = 0.002) -> Crf:
    """Maximum conditional likelihood by Adagrad over whole chains; the gradient from forward and backward sums."""
    names = sorted({f for chain, _ in chains for fs in chain for f in fs})
    index = {f: i for i, f in enumerate(names)}
    x = [[np.array([index[f] for f in fs]) for fs in chain] for chain, _ in chains]
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    gw, gt = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        for rows, (_, y) in zip(x, chains):
            n = len(rows)
            if not n:
                continue
            e = np.zeros((n, 2))
            e[:, 1] = [w[r].sum() for r in rows]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = e[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp(ahead[i - 1, 0] + t[0], ahead[i - 1, 1] + t[1]) + e[i]
            for i in range(n - 2, -1, -1):
                v = e[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(t[:, 0] + v[0], t[:, 1] + v[1])
            z = np.logaddexp(*ahead[-1])
            p = np.exp(ahead[:, 1] + behind[:, 1] - z)
            grad = -l2 * w
            for r, true, guess in zip(rows, y, p):
                grad[r] += true - guess
            step = -l2 * t
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + t[None] + (e + behind)[1:, None, :] - z)
                step = step - pair.sum(axis=0)
                np.add.at(step, (np.array(y[:-1]), np.array(y[1:])), 1)
            gw += grad**2
            gt += step**2
            w += rate * grad / np.sqrt(gw)
            t += rate * step / np.sqrt(gt)
    return Crf(dict(zip(names, w.tolist())), tuple(map(tuple, t.tolist())))


def labelled_pages(n: int = 160, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, its main text blocks) of pages from templates of many kinds, with invented words."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("ba", "lo", "mi", "tur", "es", "ka", "ren", "o")) for _ in range(rnd.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda a, b: some(a, b).capitalize() + rnd.choice(("", ".", ".", ".", "!", "?"))
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    named = lambda tag, names, inner: f'<{tag} {rnd.choice(("class", "id"))}="{rnd.choice(names)}">{inner}</{tag}>'
    junk = [
        lambda: "<nav><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(3, 8))) + "</ul></nav>",
        lambda: named("div", ("menu", "navbar", "breadcrumbs", "toolbar"), "".join(f"<li>{link()}" for _ in range(rnd.randint(2, 6)))),
        lambda: named("div", ("ad", "ads", "advert", "banner", "promo", "sponsored"), sentence(3, 40)),
        lambda: named("div", ("cookie-notice", "consent", "alert", "newsletter", "popup"), f"<p>{sentence(4, 30)}</p><button>{some(1, 2)}</button>"),
        lambda: "<aside>" + f"<h3>{some(1, 3)}</h3>" + "".join(f"<p>{sentence(3, 30)}</p>" for _ in range(rnd.randint(1, 3))) + "</aside>",
        lambda: named("div", ("sidebar", "related", "widget", "share"), f"<h3>{some(1, 3)}</h3><ul><li>{link()}</li><li>{sentence(3, 12)}</li></ul>"),
        lambda: f"<form><label>{some(1, 3)}</label><input><select><option>{word()}<option>{word()}</select><p>{sentence(3, 20)}</p><button>{word()}</button></form>",
        lambda: "<header>" + rnd.choice((f"<h1>{some(1, 4)}</h1>", f"<p>{sentence(2, 15)}</p>", link())) + "</header>",
        lambda: named("div", ("masthead", "header", "login", "search"), some(1, 6)),
    ]
    comments = lambda: rnd.choice((
        lambda: named("section", ("comments", "comment-list", "respond"), f"<h2>{some(1, 2)}</h2>" + "".join(f"<p>{sentence(3, 40)}</p>" for _ in range(rnd.randint(1, 5)))),
        lambda: named("div", ("comments", "comment", "discussion", "replies"), "".join(f'<div class="comment"><b>{word()}</b><p>{sentence(3, 40)}</p></div>' for _ in range(rnd.randint(1, 5)))),
    ))()
    for _ in range(n):
        kept: list[str] = []

        def paragraph(tag: str, a: int, b: int) -> str:
            said = sentence(a, b)
            kept.append(" ".join(said.split()))
            shown = said if rnd.random() < 0.7 else f"<b>{said}" + rnd.choice(("</b>", "<br>"))
            return f"<{tag}>{shown}" + ("" if tag == "p" and rnd.random() < 0.3 else f"</{tag}>")

        title = some(2, 8)
        body = ([paragraph("h1", 2, 10)] if rnd.random() < 0.9 else [])
        for _ in range(rnd.randint(1, 12)):
            r = rnd.random()
            if r < 0.08:
                body.append(paragraph(rnd.choice(("h2", "h3")), 1, 6))
            elif r < 0.14:
                body.append("<ul>" + "".join(paragraph("li", 1, 12) for _ in range(rnd.randint(1, 4))) + "</ul>")
            elif r < 0.18:
                body.append("<blockquote>" + paragraph("p", 4, 30) + "</blockquote>")
            else:
                body.append(paragraph("p", 1, 90))
            if rnd.random() < 0.06:
                body.append(rnd.choice(junk)())
        inner = "".join(body) + (comments() if rnd.random() < 0.25 else "") + (f"<footer>{sentence(2, 12)}</footer>" if rnd.random() < 0.1 else "")
        wrap = rnd.choice(("article", "article", "article", "main", "div"))
        main = f"<article>{inner}</article>" if wrap == "article" else f"<main>{inner}</main>" if wrap == "main" else named("div", ("content", "post", "entry-content", "article-text", "story"), inner)
        before, after = [rnd.choice(junk)() for _ in range(rnd.randint(1, 4))], [rnd.choice(junk)() for _ in range(rnd.randint(0, 3))]
        foot = f"<footer>&copy; {some(1, 3)} &middot; {sentence(2, 14)}</footer>" if rnd.random() < 0.8 else named("div", ("footer", "copyright", "legal"), sentence(3, 15))
        tail = comments() if rnd.random() < 0.25 else ""
        yield f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{main}{tail}{''.join(after)}{foot}</body></html>", kept


@cache
def trained() -> Crf:
    chains = []
    for page, kept in labelled_pages():
        found, left = blocks(page), list(kept)
        labels = []
        for b in found:
            mine = bool(left) and b.text == left[0] and not (b.inside and b.inside.tags & {"head", "title"})
            labels.append(int(mine))
            if mine:
                left.pop(0)
        chains.append(([block_features(b) for b in found], labels))
    return fit(chains)


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, label in zip(found, model.decode([block_features(b) for b in found])) if label)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        texts = [main_text(p, shared.value) for p in batch["html"].to_pylist()]
        return [batch["page_id"], batch["url"], texts, [len(t) for t in texts]]

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_batches(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", work)
