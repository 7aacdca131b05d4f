"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page, decoded by Viterbi."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.llm.crf import Chain, train_chain, viterbi

#: Labelled pages that train the model; they are built from layouts by a rule (``labelled_pages``).
TRAIN_PAGES = 500
BATCH_ROWS = 256
_NAMES = lambda text: frozenset(text.split())
BLOCKS = _NAMES(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup "
    "option p pre search section select summary table tbody td textarea tfoot th thead title tr ul"
)
VOID = _NAMES("area base br col embed frame hr img input link meta param source track wbr")
RAW = _NAMES("script style template xmp noembed")
#: What an opening tag closes before it, up to the border tags.
CLOSES = {
    "li": ("li", _NAMES("ul ol menu")),
    "dt": ("dt dd", _NAMES("dl")),
    "dd": ("dt dd", _NAMES("dl")),
    "tr": ("tr td th", _NAMES("table")),
    "td": ("td th", _NAMES("tr table")),
    "th": ("td th", _NAMES("tr table")),
    "option": ("option", _NAMES("select")),
}
P_ENDS = BLOCKS - _NAMES("button caption dd dt head html body iframe label legend noscript optgroup option select tbody td textarea tfoot th thead title tr")
_MARK = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    marks: tuple[str, ...]
    inner: tuple[str, ...]
    tag: str
    linked: float


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    found = ["a:" + tag]
    if "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.lower()
            if name in ("class", "id", "role"):
                found += ["c:" + p for p in _PART.findall(value)]
            elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none", value):
                found.append("hidden")
    return tuple(found)


def leaf_blocks(page: str) -> list[Block]:
    """The page's runs of text between block tags, with white space made plain and references decoded.

    The time grows with the page, however deep it is nested. Text in scripts, styles and comments is no block. Tags left open are closed as a browser would in the common
    cases: a paragraph by the next block, a list item or cell by the next one, anything by the end of what holds it.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}
    open_marks: dict[str, int] = {}
    named: list[int] = []
    buffer: list[str] = []
    linked = 0
    at = 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            k = last(BLOCKS)
            inner = stack[named[-1]][1] if named else ()
            blocks.append(Block(text, tuple(open_marks), inner, stack[k][0] if k >= 0 else "", linked / len(text)))
        buffer.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if any(t == "a" for t, _ in stack[-4:]):
            linked += len(text.strip())

    def close(names, borders) -> None:
        """Close the innermost of ``names``, and all in it, unless a border stands further in."""
        k = last(names)
        if k >= 0 and k >= last(borders):
            for tag, marks in stack[k:]:
                places[tag].pop()
                for m in marks:
                    open_marks[m] -= 1
                    if not open_marks[m]:
                        del open_marks[m]
            del stack[k:]
            while named and named[-1] >= k:
                named.pop()

    closed = page.rfind(">")
    while at < len(page):
        mark = _MARK.search(page, at) if at <= closed or page.find("<!--", at) >= 0 else None
        if not mark:
            put(page[at:])
            break
        if mark.start() > at:
            put(page[at : mark.start()])
        at = mark.end()
        if not mark[2]:
            continue
        tag = mark[2].lower()
        if tag in BLOCKS:
            flush()
        if mark[1]:
            close((tag,), () if tag in BLOCKS else BLOCKS)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        if tag in P_ENDS:
            close(("p",), _NAMES("button table td th"))
        if tag in CLOSES:
            names, borders = CLOSES[tag]
            close(names.split(), borders)
        if not mark[3].rstrip().endswith("/") or tag in BLOCKS:
            marks = _marks(tag, mark[3])
            for m in marks:
                open_marks[m] = open_marks.get(m, 0) + 1
            if len(marks) > 1:
                named.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, marks))
    flush()
    return blocks


_SECTIONS = _NAMES("article main nav header footer aside form section body head")


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Named features of each block: its holders, the nearest section, its size, links, signs, and how it opens."""
    out = []
    for block in blocks:
        near = next((m for m in reversed(block.marks) if m[2:] in _SECTIONS and m[0] == "a"), "a:none")
        words = block.text.split(" ", 12)
        size = min(len(words), 12)
        found = ["bias", *block.marks, *("inner" + m for m in block.inner[1:]), "near" + near, "tag:" + block.tag, f"words:{size // 3}", "linked" if block.linked > 0.5 else "plain"]
        found.append("ends" if block.text[-1] in ".!?…" else "open")
        if "©" in block.text[:40]:
            found.append("copyright")
        found += ["w:" + p for w in words[:4] for p in _PART.findall(w.lower())]
        out.append(found)
    return out


#: Fixed values of the layouts: names that hold main text, names that hold other text, and how such text opens.
HOLDERS = ("article", "main", "main|article", "section.post", "div.content", "div.article-body", "div#content", "div.post|div.entry", "div.story", "div#main-content", "body|article", "div.wrapper|article", "div.container|main")
MENUS = ("nav", "ul.menu", "div.navbar", "div.breadcrumb", "header|nav", "div#nav", "div.topbar")
HEADERS = ("header", "div.header", "div.masthead", "div#header", "div.site-header")
FOOTERS = ("footer", "div.footer", "div#footer", "div.copyright", "div.site-footer")
SIDES = ("aside", "div.sidebar", "div.related", "div.widget", "div#sidebar", "aside.recommended", "div.trending")
ADVERTS = ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "aside.ad", "section.sponsor", "div.ad-slot")
NOTICES = ("div.cookie", "div.cookie-notice", "div.notice", "div.consent", "div.alert", "div.gdpr", "div.paywall", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.share", "div.social")
COMMENTS = ("section.comments|div.comment", "div#comments|div.comment", "div.comments", "ol.comment-list|li.comment", "section#comments", "div.reader-comments", "div.discussion|div.reply")
FORMS = ("form", "form.search", "div.login|form", "form.signup", "form|fieldset")
OPENINGS = {
    "menu": "Home About Contact News Login Search Archive Shop Help Start".split(),
    "header": ("Welcome to our site", "The daily page", "Your local news", "Site header"),
    "footer": ("© 2024 All rights reserved.", "Copyright 2023", "Privacy policy | Terms", "© site · contact"),
    "side": ("Related articles", "Most read", "Popular now", "See also", "About the author"),
    "advert": ("Advertisement", "Buy now and save", "Sponsored content", "Special offer", ""),
    "notice": ("We use cookies", "Subscribe to our newsletter", "This site uses cookies", "Share this", "Sign up today"),
    "comment": ("Great article!", "I disagree with this.", "Thanks for sharing.", "Posted by reader", "Reply", ""),
    "form": ("Your email", "Search", "Password", "Send", "Name"),
}
_SYLLABLES = "ka lo mi ren ta sol vi der an the in or ve st el mo na tu ri po den sch é ó ü ción ment".split()


def _open(path: str, inner: str) -> str:
    for step in reversed(path.split("|")):
        tag, sign, name = re.match(r"(\w+)([.#]?)(.*)", step).groups()
        attribute = {"": "", ".": f' class="{name}"', "#": f' id="{name}"'}[sign]
        inner = f"<{tag}{attribute}>{inner}</{tag}>"
    return inner


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 5) -> list[tuple[str, set[int]]]:
    """Pages put together from the layouts, with the numbers of the leaf blocks that are main text.

    Main text is marked while the page is made (every block of it opens with a sign that is taken out again). Some
    pages are an article alone or have no holder, some articles are a line, and main text may open as other text does.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]

    def words(low: int, high: int) -> str:
        n = int(rng.integers(low, high))
        made = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        return " ".join(made).capitalize() + pick((".", ".", ".", "", "!"))

    def said(low: int, high: int) -> str:
        if rng.integers(4):
            return words(low, high)
        opening = pick([o for of in OPENINGS.values() for o in of])
        return pick((f"{opening} {words(low, high)}", opening)) or words(1, 4)

    def other(kind: str, paths) -> str:
        if kind == "menu":
            items = "".join(f'<li><a href="/x">{pick((*OPENINGS["menu"], words(1, 3)))}</a></li>' for _ in range(int(rng.integers(2, 7))))
            path = pick(paths)
            return _open(path, items if path.startswith("ul") else f"<ul>{items}</ul>")
        opening = pick(OPENINGS[kind])
        text = pick((opening, f"{opening} {words(2, 14)}", words(1, 25)))
        if kind == "form":
            text = f'<label>{opening}</label><input name="q"><button>{words(1, 2)}</button>' + pick(("", f"<p>{words(3, 9)}</p>"))
        elif rng.integers(2):
            text = f"<p>{text}</p>" + (f"<p>{words(2, 20)}</p>" if rng.integers(2) else "")
        return _open(pick(paths), text)

    pages = []
    for _ in range(count):
        body = []
        short = not rng.integers(5)
        if rng.integers(3) if short else rng.integers(8):
            body.append(pick((f"<h1>\x01{said(2, 9)}</h1>", f"<h1>\x01{said(2, 9)}</h1>", f"<h2>\x01{said(2, 9)}</h2>")))
        for _ in range(pick((0, 1, 1, 2)) if short and body else int(rng.integers(1, 2 if short else 9))):
            long = said(*pick(((1, 3), (3, 10), (10, 40), (20, 60))))
            kind = int(rng.integers(12))
            if kind < 7:
                body.append(f"<p>\x01{long}" + pick(("</p>", "</p>", "")))
            elif kind == 7:
                body.append(f"<p><b>\x01{long}<br><p>\x01{said(1, 20)}</p>")
            elif kind == 8:
                body.append("<ul>" + "".join(f"<li>\x01{said(1, 9)}</li>" for _ in range(3)) + "</ul>")
            elif kind == 9:
                body.append(pick((f"<blockquote>\x01{long}</blockquote>", f"<pre>\x01{long}</pre>", f"<h2>\x01{said(1, 6)}</h2>", f"<h3>\x01{said(1, 6)}</h3>")))
            elif kind == 10:
                body.append(f"<table><tr><td>\x01{said(1, 4)}</td><td>\x01{said(1, 4)}</td></tr></table>")
            else:
                body.append(f"<figure><img src=x><figcaption>\x01{said(2, 9)}</figcaption></figure>")
        inside = (("advert", ADVERTS), ("side", SIDES), ("notice", NOTICES), ("comment", COMMENTS), ("form", FORMS))
        for kind, paths in inside:
            if not short and not rng.integers(5):
                body.insert(int(rng.integers(1, len(body) + 1)), other(kind, paths))
        before = [other(k, p) for k, p in (("header", HEADERS), ("menu", MENUS), ("notice", NOTICES), ("advert", ADVERTS), ("form", FORMS)) if rng.integers(3)]
        after = [other(k, p) for k, p in (("side", SIDES), ("comment", COMMENTS), ("advert", ADVERTS), ("notice", NOTICES), ("form", FORMS), ("footer", FOOTERS)) if rng.integers(3)]
        article = _open(pick(HOLDERS), "".join(body)) if rng.integers(9) else "".join(body)
        title = f"<head><title>{words(2, 8)}</title></head>" if rng.integers(4) else ""
        if rng.integers(6):
            page = f"<html>{title}<body>{''.join(before)}{article}{''.join(after)}</body></html>"
        else:
            page = pick((article, f"<html>{title}<body>{article}</body></html>"))
        page = page.replace("<body><body>", "<body>").replace("</body></body>", "</body>")
        main = {k for k, b in enumerate(leaf_blocks(page)) if b.text.startswith("\x01")}
        pages.append((page.replace("\x01", ""), main))
    return pages


def train(pages: list[tuple[str, set[int]]] | None = None) -> Chain:
    sequences, labels = [], []
    for page, main in labelled_pages() if pages is None else pages:
        blocks = leaf_blocks(page)
        if blocks:
            sequences.append(block_features(blocks))
            labels.append([int(k in main) for k in range(len(blocks))])
    return train_chain(sequences, labels, 2, ends=False)


def main_blocks(page: str | None, model: Chain) -> list[str]:
    blocks = leaf_blocks(page or "")
    path = viterbi(model.emissions(block_features(blocks)), model)
    return [b.text for b, label in zip(blocks, path, strict=True) if label]


def _extracted(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(page.as_py(), model)) for page in batch["html"]]
            columns = {c: batch[c] for c in batch.schema.names if c != "html"}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array(list(map(len, texts)), pa.int64())
            yield pa.record_batch(columns)

    return run


def extracted(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): the main text and its code points.

    A null or empty page, and one without main text, gives an empty text. Pages are read whole. Repeated rows give
    repeated results. An empty table gives an empty result; other columns are ignored.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_extracted(model or train()), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return extracted(table(spark, sf_dir, "pages"))
