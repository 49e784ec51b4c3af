"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements and runs of text. Each node has features: its tag, attribute
tokens, depth, text, link and tag density of its subtree, statistics of its siblings, and what its
ancestors are. Trees, fitted on TRAINING_PAGES pages of two kinds that this module writes with known main text, give
each node the log-odds that it belongs to the article. Decoding then picks the best consistent labelling:
nodes are around the article, in it, or dropped; below a dropped node all is dropped, and only what is
around the article may hold something of it further down.

A block's text is one line: a br in it is white space, and what is skipped in it leaves nothing.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes: of
a skipped element without an end tag just the tag is skipped, unless it is raw text, and a head ends where
something stands that may not be in it; a slash closes svg tags and no others; repeated rows and null ids are kept; an empty table gives no rows;
pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html as html_
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from maskwerk.llm.boosting import Boosted

#: Pages written for the fit: the bound on its sample.
TRAINING_PAGES = 750

OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
# In attributes: a value in quotes, which may hold a >, or the end of the tag.
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# How HTML elements behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("applet audio button canvas map noscript object select svg template video".split())
# Of these all is text up to the end tag, or, as in browsers, up to the end of the page if there is none.
RAW = frozenset("iframe noframes script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPES = frozenset("ul ol dl table body html".split())

# Tags with a feature of their own, and tokens of attributes by what they hint at.
TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "table", "tr", "td", "blockquote", "pre", "figure", "body", "#text"]
HINTS = {
    "advert": "ad ads advert advertisement adbox adslot banner promo promoted sponsor sponsored dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager",
    "head": "header masthead sitehead logo branding hero",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget rail secondary complementary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert message",
    "talk": "comment comments discussion respond reply replies disqus reviews feedback",
    "links": "related share sharing social recommended more tags popular trending follow author-links",
    "form": "form search login signup newsletter subscribe subscription contact register",
    "body": "content article post entry main body text story page-content articlebody post-body entry-content",
}
TOKEN_HINT = {t: k for k, (_, tokens) in enumerate(HINTS.items()) for t in tokens.split()}
ABOVE = ["nav", "header", "footer", "aside", "form", "article", "main"]
#: Log-odds that it takes, beyond its own, to drop a node from what is in the article.
SWITCH = 4.0
FEATURES = len(TAGS) + len(HINTS) + len(ABOVE) + len(HINTS) + 18


def tags_of(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty for comments), whether it closes, and attributes of each tag; a raw-text element is one tag with its text.

    Read once from left to right. A quote is one only behind an equals sign. A tag whose quotes hide every > up
    to the end of the page ends at its first >, and so do all behind it, which keeps the reading linear.
    """
    at, last, plain = 0, source.rfind(">"), False
    while m := OPEN.search(source, at):
        start, tag, attributes = m.start(), (m[3] or "").lower(), ""
        if not tag:
            end = source.find("-->" if m[1] else ">", m.end())
            at = len(source) if end < 0 else end + (3 if m[1] else 1)
        else:
            end = source.find(">", m.end()) if m.end() <= last else -1
            if end < 0:  # no tag any more
                return
            if not plain and ('"' in (body := source[m.end() : end]) or "'" in body):
                k = m.end()
                while (q := QUOTED.search(source, k)) and q[0] != ">":
                    k = q.end()
                plain = not q
                end = q.start() if q else end
            attributes, at = source[m.end() : end], end + 1
            if tag in RAW and not m[2]:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
        yield start, at, tag, bool(m[2]), attributes


def closes_itself(attributes: str) -> bool:
    """Whether a slash ends a tag's attributes, and not an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'][^\s]*$", attributes)


def ends_of(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Where in tags the skipped elements start and end; one whose end tag is missing is not among them."""
    ends, still_open = {}, {tag: [] for tag in SKIPPED}
    for k, (_, _, tag, closing, attributes) in enumerate(tags):
        if tag in SKIPPED:
            if not closing:
                # Only in foreign elements does a slash close a tag.
                if tag != "svg" or not closes_itself(attributes):
                    still_open[tag].append(k)
            elif still_open[tag]:
                ends[still_open[tag].pop()] = k
    return ends


class Page:
    """The tree of a page: for each node its parent (earlier in the lists), tag, hints, text and linked letters.

    What is skipped inside a block, like a script, parts its text into nodes; glue has the white space between
    such a node and the one before it (None: a block of its own). For features and decoding such nodes are one: the first
    has the letters of all and the label, the others count as nothing.
    """

    __slots__ = ("glue", "linked", "parent", "hints", "tag", "text")

    def __init__(self, source: str):
        self.parent, self.tag, self.hints, self.text, self.linked, self.glue = [-1], ["html"], [0], [""], [0], [None]
        stack, pieces, linked, links, at = [0], [], 0, 0, 0
        # The node that goes on behind something skipped, and whether white space was there.
        goes_on, white = -1, False

        def flush(block: bool = True) -> None:
            nonlocal linked, goes_on, white
            if pieces:
                raw = html_.unescape("".join(pieces))
                text = " ".join(raw.split())
                if text:
                    at = self._add(stack[-1], "#text", 0, text, min(linked, len(text)))
                    if goes_on == at - 1:
                        self.glue[at] = " " if white or raw[0].isspace() else ""
                    goes_on, white = at, raw[-1].isspace()
                else:
                    white = white or bool(raw)
                pieces.clear()
            if block:
                goes_on = -1
            linked = 0

        tags = list(tags_of(source))
        ends, k = ends_of(tags), 0
        while k < len(tags):
            start, end, tag, closing, attributes = tags[k]
            if start > at:
                pieces.append(source[at:start])
                if links:
                    linked += start - at
            at, here, k = end, k, k + 1
            if not tag:
                continue
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag not in INLINE and tag not in VOID:
                    flush()
                    for j in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[j]] == tag:
                            del stack[j:]
                            break
                continue
            if tag == "head" or tag in RAW | SKIPPED:
                # What may stand in a head is skipped by itself; what may not ends the head and is shown.
                flush(block=tag == "head") if tag != "button" else None
                if here in ends:
                    k = ends[here] + 1
                    at = tags[k - 1][1]
            elif tag == "a":
                links += 1
            elif tag == "br":
                pieces.append("\n")
            elif tag not in INLINE:
                flush()
                if tag in VOID:
                    continue
                if self.tag[stack[-1]] == "p":
                    stack.pop()
                elif "p" in (self.tag[j] for j in stack[-3:]) and tag == "p":
                    while self.tag[stack.pop()] != "p":
                        pass
                if tag in CLOSED_BY:
                    for j in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[j]] in CLOSED_BY[tag]:
                            del stack[j:]
                            break
                        if self.tag[stack[j]] in SCOPES:
                            break
                stack.append(self._add(stack[-1], tag, self._hinted(attributes), "", 0))
        pieces.append(source[at:])
        flush()

    def _add(self, parent: int, tag: str, hints: int, text: str, linked: int) -> int:
        for column, value in zip((self.parent, self.tag, self.hints, self.text, self.linked, self.glue), (parent, tag, hints, text, linked, None), strict=True):
            column.append(value)
        return len(self.tag) - 1

    @staticmethod
    @functools.lru_cache(10_000)
    def _hinted(attributes: str) -> int:
        out = 0
        for m in ATTRIBUTE.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                for t in (token, *re.split(r"[-_\d]+", token)):
                    if t in TOKEN_HINT:
                        out |= 1 << TOKEN_HINT[t]
        return out

    def blocks(self) -> list[str | None]:
        """For each node, the text of the block that begins there, if one does."""
        out, first = [t or None for t in self.text], 0
        for i, glue in enumerate(self.glue):
            if glue is not None:
                out[first], out[i] = f"{out[first]}{glue}{out[i]}", None
            elif self.text[i]:
                first = i
        return out

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        chars, linked, marks, words = ([0] * n for _ in range(4))
        tags, children, depth, above, above_hints = ([0] * n for _ in range(5))
        first = 0
        for i in range(n):
            if t := self.text[i]:
                first = i if (glue := self.glue[i]) is None else first
                chars[first] += len(t) + len(glue or "")
                linked[first] += self.linked[i]
                marks[first] += t.count(".") + t.count(",")
                words[first] += t.count(" ") + 1 if glue is None else t.count(" ") + len(glue)
            else:
                tags[i] = 1
            if i:
                p = parent[i]
                children[p] += self.glue[i] is None
                depth[i] = depth[p] + 1
                above[i] = above[p] | (1 << ABOVE.index(self.tag[p]) if self.tag[p] in ABOVE else 0)
                above_hints[i] = above_hints[p] | self.hints[p]
        seen = [0] * n
        total = 0
        for i in range(n):
            seen[i] = total
            total += chars[i]
        texts = [int(bool(t) and g is None) for t, g in zip(self.text, self.glue, strict=True)]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for column in (chars, linked, marks, words, tags, texts):
                column[p] += column[i]
        top = [0] * n
        last = [-1] * n
        before, after = [0] * n, [0] * n
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            if self.glue[i] is not None:
                continue
            p = parent[i]
            top[p] = max(top[p], chars[i])
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
            if last[p] >= 0:
                before[i], after[last[p]] = chars[last[p]], chars[i]
            last[p] = i
        out = np.zeros((n, FEATURES), np.float32)
        index = {t: k for k, t in enumerate(TAGS)}
        for i, t in enumerate(self.tag):
            if t in index:
                out[i, index[t]] = 1
        k = len(TAGS)
        for column, count in ((self.hints, len(HINTS)), (above, len(ABOVE)), (above_hints, len(HINTS))):
            out[:, k : k + count] = (np.array(column)[:, None] >> np.arange(count)) & 1
            k += count
        p = np.array([0, *parent[1:]])
        c, l, w, g, ch = (np.array(x, float) for x in (chars, linked, words, tags, children))
        size = max(1.0, c[0])
        numbers = [
            np.array(depth), np.array(seen) / size, 1 - (np.array(seen) + c) / size, np.log1p(c), c / size, l / np.maximum(c, 1), g / np.maximum(c, 1) * 100,
            np.array(marks) / np.maximum(w, 1), c / np.maximum(w, 1), ch, ch[p], np.array([same.get((q, t), 0) for q, t in zip(parent, self.tag, strict=True)]),
            c / np.maximum(c[p], 1), c / np.maximum(np.array(top)[p], 1), np.log1p(before), np.log1p(after), c / np.maximum(np.array(texts), 1), np.log1p(c[p] / np.maximum(ch[p], 1)),
        ]
        out[:, k:] = np.stack(numbers, 1)
        return out

    def decode(self, odds: list[float]) -> list[str]:
        """Blocks of text that the best consistent labelling has in the article, in page order."""
        n = len(self.tag)
        odds = [0.0 if g is not None else x for x, g in zip(odds, self.glue, strict=True)]
        inside, drop, around = list(odds), [-x for x in odds], [0.0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            inside[p] += max(inside[i], drop[i] - SWITCH)
            drop[p] += drop[i]
            around[p] += max(inside[i], drop[i]) if self.text[i] else max(around[i], inside[i], drop[i])
        state = ["around"] * n
        for i in range(1, n):
            up = state[self.parent[i]]
            if self.glue[i] is not None:
                state[i] = state[i - 1]
            elif up == "drop":
                state[i] = "drop"
            elif up == "inside":
                state[i] = "inside" if inside[i] > drop[i] - SWITCH else "drop"
            elif self.text[i]:
                state[i] = "inside" if inside[i] > drop[i] else "drop"
            else:
                state[i] = max(("around", around[i]), ("inside", inside[i]), ("drop", drop[i]), key=lambda x: x[1])[0]
        out: list[str] = []
        for i in range(n):
            if self.text[i] and state[i] == "inside":
                if self.glue[i] is not None:
                    out[-1] += self.glue[i] + self.text[i]
                else:
                    out.append(self.text[i])
        return out


def linking(rng: random.Random, text: str) -> str:
    """Some text of an article, now and then with a link in it, or mostly a link, and something skipped behind that."""
    words = text.split(" ")
    if rng.random() < 0.75 or "&" in text or len(words) < 4:
        return text
    size = rng.randint(1, 5) if rng.random() < 0.8 else len(words) * 2 // 3
    at = rng.randrange(len(words) - size) if len(words) > size else 0
    skipped = rng.choice(["", "", "<script>var t = 1;</script>", "<svg><path d=x></svg>"])
    return " ".join([*words[:at], f'<a href="/{words[at]}">{" ".join(words[at : at + size])}</a>{skipped}', *words[at + size :]])


def written_page(seed: int) -> tuple[str, set[str]]:
    """A page of random layout, and the texts of its main text's blocks."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er in".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    main: set[str] = set()

    def sentence(low: int = 4, high: int = 22) -> str:
        words = [word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).rstrip(",").capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(low: int = 1, high: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def keep(text: str) -> str:
        text = " ".join(text.split())
        main.add(text)
        return html_.escape(text, quote=False)

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{word()}{" " + word() if rng.random() < 0.3 else ""}</a></{tag}>' for _ in range(n))

    def hint(kind: str) -> str:
        tokens = HINTS[kind].split()
        token = rng.choice(tokens) if rng.random() < 0.8 else f"{rng.choice(tokens)}-{word()}"
        return rng.choice([f' class="{token}"', f' class="{word()} {token}"', f' id="{token}"', f" class={token}"])

    def block() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = linking(rng, keep(prose() if rng.random() < 0.9 else sentence(4, 9)))
            return rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>", f"<div>{text}</div>"])
        if kind < 0.8:
            return f"<h2>{keep(sentence(2, 8))}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{keep(prose(1, 3))}</blockquote>"
        if kind < 0.95:
            return f"<pre>{keep(sentence())}</pre>"
        return rng.choice([boxed("advert"), boxed("links")])

    def boxed(kind: str) -> str:
        tag = {"advert": "div", "menu": "nav", "head": "header", "foot": "footer", "side": "aside", "notice": "div", "talk": "section", "links": "div", "form": "form"}[kind]
        mark = hint(kind) if tag in ("div", "section") or rng.random() < 0.4 else ""
        if tag not in ("div", "section") and rng.random() < 0.35:
            tag, mark = "div", hint(kind)
        inner = {
            "advert": lambda: rng.choice([sentence(), prose(1, 2), f"<p>{sentence()}</p>", f'<a href="/x">{sentence()}</a>']),
            "menu": lambda: rng.choice([f"<ul>{links(rng.randint(3, 9))}</ul>", links(rng.randint(2, 6), "span")]),
            "head": lambda: f"<h1>{word()}</h1><p>{sentence(2, 9)}</p>" + (f"<ul>{links(4)}</ul>" if rng.random() < 0.5 else ""),
            "foot": lambda: rng.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>{prose(1, 2)}</p><ul>{links(3)}</ul>", f"<p>&copy; {sentence(2, 6)}</p>"]),
            "side": lambda: f"<h3>{word()}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", f"<p>{prose(1, 2)}</p>"]),
            "notice": lambda: f"<p>{prose(1, 3)}</p><button>{word()}</button>",
            "talk": lambda: f"<h3>{word()}</h3>" + "".join(rng.choice([f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<p>{prose(1, 4)}</p>"]) for _ in range(rng.randint(1, 6))),
            "links": lambda: f"<h3>{word()} {word()}</h3><ul>" + "".join(f'<li><a href="/{word()}">{sentence(3, 10)}</a></li>' for _ in range(rng.randint(2, 6))) + "</ul>",
            "form": lambda: f"<label>{sentence(2, 6)}</label><input type=text><p>{sentence()}</p><button>{word()}</button>",
        }[kind]()
        return f"<{tag}{mark}>{inner}</{tag}>"

    some = lambda kinds, p: "".join(boxed(k) for k in kinds if rng.random() < p)
    title = sentence(3, 14)
    body = (f"<h1>{keep(title)}</h1>" if rng.random() < 0.85 else "") + "".join(block() for _ in range(rng.choice([1, 2, 3, 5, 9, 16])))
    if rng.random() < 0.15:
        body = f"<div>{body}</div>"
    outer = rng.choice(["article", "article", "article", "main", "section", "div", "div", "td"])
    mark = hint("body") if outer in ("section", "div", "td") else hint("body") if rng.random() < 0.3 else ""
    article = f"<{outer}{mark}>{body}{some(['links', 'talk'], 0.08)}</{outer}>"
    article = f"<table><tr>{article}</tr></table>" if outer == "td" else article
    front, back = some(["head", "menu", "notice", "advert", "form"], 0.45), some(["links", "talk", "side", "form", "advert", "menu", "notice"], 0.3) + some(["foot"], 0.8)
    page = front + some(["side"], 0.2) + article + back
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "page", "container"])}">{page}</div>'
    head = f'<head><meta charset="utf-8"><title>{html_.escape(title)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    return f"<!DOCTYPE html><html>{head}<body>{page}</body></html>", main


def foreign_page(seed: int) -> tuple[str, set[str]]:
    """A page whose class names say nothing, mostly of nested div elements, and the texts of its main text's blocks.

    So that trees have to go by text, links, places and siblings where names do not help.
    """
    rng = random.Random(f"foreign {seed}")
    letters = "abcdefghijklmnoprstuvwz"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    sentence = lambda low=2, high=20: words(low, high).capitalize() + rng.choice("...?!")
    prose = lambda low=1, high=6: " ".join(sentence() for _ in range(rng.randint(low, high)))
    scheme = rng.choice([lambda: f"c{rng.randrange(10**6):x}", lambda: f"col-md-{rng.randint(1, 12)}", lambda: f"{word()}__{word()}", lambda: f"{word()}-{rng.randrange(99)} {word()}"])
    semantic = rng.random() < 0.4
    main: set[str] = set()

    def named(tag: str, inner: str, plain: str = "div") -> str:
        tag = tag if semantic or tag in ("p", "h1", "h2", "h3", "ul", "ol", "li") else plain
        mark = f' class="{scheme()}"' if rng.random() < 0.6 else f" data-{word()}={word()}" if rng.random() < 0.2 else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def wrapped(inner: str) -> str:
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            inner = named("section", inner)
        return inner

    def keep(text: str) -> str:
        main.add(" ".join(text.split()))
        return html_.escape(text, quote=False)

    link = lambda low=1, high=3: f'<a href="/{word()}">{words(low, high)}</a>'
    items = lambda n, low=1, high=3: "".join(named("li", link(low, high)) for _ in range(n))

    def block() -> str:
        kind = rng.random()
        if kind < 0.66:
            text = keep(prose())
            if rng.random() < 0.3:  # inline markup, which ends no block
                cut = text.find(" ", len(text) // 3)
                text = f"{text[:cut]} <em>{text[cut + 1 :]}</em>" if cut > 0 and "&" not in text else text
            elif rng.random() < 0.4:
                text = linking(rng, text)
            return named("p", text) if rng.random() < 0.8 else f"<div>{text}</div>"
        if kind < 0.76:
            return named(rng.choice(["h2", "h3"]), keep(words(2, 7).capitalize()))
        if kind < 0.86:
            return named(rng.choice(["ul", "ol"]), "".join(named("li", keep(sentence())) for _ in range(rng.randint(2, 5))))
        if kind < 0.9:
            return named("figure", f"<img src=/{word()}.png>" + named("p", keep(sentence(3, 9))), "div")
        if kind < 0.94:
            return f"<blockquote>{named('p', keep(prose(1, 2)))}</blockquote>"
        return wrapped(rng.choice([named("ul", items(rng.randint(2, 5), 3, 8)), f'<div class="{rng.choice(["ad", "promo", scheme()])}"><a href="/x">{sentence(3, 9)}</a></div>']))

    def menu() -> str:
        n = rng.randint(3, 10)
        return named("nav", rng.choice([lambda: named("ul", items(n)), lambda: " | ".join(link() for _ in range(n)), lambda: "".join(f"<span>{link()}</span>" for _ in range(n))])())

    def talk() -> str:
        kind = rng.choice(["article", "section", "section"])
        one = lambda: named(kind, f"<b>{word()}</b> <span>{rng.randint(1, 28)} {word()}</span>" + named("p", prose(1, 3)) + link(1, 1))
        return f'<div class="{rng.choice(["comments", "thread", "responses", "comment-list"])}">' + named("h3", words(1, 3)) + "".join(one() for _ in range(rng.randint(1, 6))) + "</div>"

    side = lambda: named("aside", "".join(named("h3", words(1, 3)) + rng.choice([named("ul", items(rng.randint(3, 7), 2, 7)), named("p", f"{sentence(4, 12)} {link()}")]) for _ in range(rng.randint(1, 3))))
    form = lambda: f"<form action=/{word()}><label>{words(1, 4)}</label><input name=q><p>{sentence(4, 9)}</p></form>"
    notice = lambda: f'<div class="{rng.choice(["cookie-bar", "consent", scheme()])}" role="dialog">{sentence()} {link(1, 2)} <button>{word()}</button></div>'
    foot = lambda: named("footer", rng.choice([f"&copy; {rng.randint(1990, 2030)} {words(1, 3)}", named("p", f"{words(1, 4)} {link()} {link()}"), f"<ul>{items(4)}</ul>&copy; {words(1, 2)}"]))
    head = lambda: named("header", f"<a href=/>{words(1, 2)}</a>" + (f"<p>{words(3, 8)}</p>" if rng.random() < 0.5 else ""))
    some = lambda f, p: wrapped(f()) if rng.random() < p else ""
    title = words(1, 10).capitalize()
    body = (named("h1", keep(title)) if rng.random() < 0.9 else "") + "".join(block() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])))
    article = wrapped(named(rng.choice(["article", "main"]), body))
    if rng.random() < 0.1:  # the article and nothing else
        return article, main
    page = some(notice, 0.25) + some(head, 0.7) + some(menu, 0.7) + some(side, 0.15) + article + some(talk, 0.25) + some(side, 0.35) + some(form, 0.2) + some(notice, 0.1) + some(foot, 0.85)
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{page}</body></html>", main


@functools.lru_cache(1)
def fitted(pages: int = TRAINING_PAGES) -> Boosted:
    """Trees over nodes of written pages, two in five foreign ones. A node counts as article if all text below it is."""
    xs, ys = [], []
    for seed in range(pages):
        source, main = foreign_page(seed) if seed % 5 in (1, 3) else written_page(seed)
        page = Page(source)
        own = [None if t is None else int(t in main) for t in page.blocks()]
        whole = [o != 0 for o in own]
        has = [o is not None for o in own]
        for i in range(len(own) - 1, 0, -1):
            whole[page.parent[i]] &= whole[i]
            has[page.parent[i]] |= has[i]
        rows = [i for i in range(1, len(own)) if has[i]]
        xs.append(page.features()[rows])
        ys += [whole[i] for i in rows]
    return Boosted(trees=60, depth=5).fit(np.concatenate(xs), np.array(ys, float))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    tables = [p.features() for p in pages]
    odds = model.odds(np.concatenate(tables))
    ends = np.cumsum([len(t) for t in tables])
    return ["\n".join(p.decode(odds[e - len(t) : e].tolist())) for p, t, e in zip(pages, tables, ends, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_texts([s or "" for s in part["html"].to_pylist()], model)
                yield pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
