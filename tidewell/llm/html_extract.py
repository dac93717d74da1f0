"""Main-text extraction by tag-path ratios.

Each block of text belongs to a root-to-leaf path of block tags with their classes. Over a page, the text
length, the punctuation and the link text of each path are summed. A path's ratio is its text for each
block, times its punctuation, less what is link text. Ratios are smoothed with those of the paths that
stand directly in the same container, fused with the container's mass (the text and punctuation that
stand directly in it; the nearer and heavier of the enclosing containers counts), and paths above a share
of the page's best are its content. So an advertisement between two containers has the ratio of its own
few words, and a headline or a short list has that of the article around it.

Outside all of that are elements that HTML itself sets apart (menus, asides, forms, scripts). Labels by
which authors name what isn't the article (a class or id like `comments`) weigh a path's ratio down.
"""

from __future__ import annotations

import html
import re
from math import log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by kind.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "html", "div", "nav", "aside", "footer", "header", "blockquote", "td", "th"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "svg", "head", "menu", "object", "audio", "video", "canvas", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
NOISE_NAMES = re.compile(r"(ad|ads|adbox|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notification|alert|popup|modal|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|comments?|comment-?list|disqus\w*|replies|widget|pagination|pager|skip-?link|hidden)([-_](box|area|bar|list|section|container|wrapper|block|thread|form|unit|slot|\d+))*", re.I)
SECTIONS = {"article", "main", "section"}  # a header within one belongs to its content

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？؟،]")


def _step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element as a step of a path: its tag with its class, whether HTML sets it apart or hides it, and whether its author's labels do."""
    if not attributes or tag in ("html", "body", "main", "article"):
        return tag, tag in NOISE_TAGS, False
    apart, label, name_of = tag in NOISE_TAGS, False, tag
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            name_of = f"{tag}.{value}"
        label |= name in ("class", "id") and any(NOISE_NAMES.fullmatch(x) for x in value.split())
        apart |= name == "role" and value.lower() in NOISE_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value, re.I))
    return name_of, apart or bool(re.search(r"(^|\s)hidden(\s|=|/|$)", ATTRIBUTE.sub(lambda m: " hidden " if m[1].lower() == "hidden" else " ", attributes), re.I)), label


def blocks(page: str) -> list[tuple[tuple, bool, bool, str, int]]:
    """The page's text blocks in order: (path, set apart by HTML, labelled by the author, text, characters of links)."""
    out: list[tuple] = []
    stack: list[tuple[str, tuple]] = []
    held: list[str] = []
    links = depth = at = 0

    def flush():
        nonlocal held, links
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            tags = {t for t, _ in stack}
            apart = any(step[1] for _, step in stack) or ("header" in tags and not SECTIONS & tags)
            out.append((tuple(step[0] for _, step in stack), apart, any(step[2] for _, step in stack), text, min(links, len(text))))
        held, links = [], 0

    def add(text: str):
        nonlocal links
        if text:
            held.append(text)
            links += len(text.strip()) if depth else 0

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            add(rest[: cut] if (cut := rest.rfind("<")) >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)  # a tag that the page breaks off
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
        elif tag in INLINE:
            if tag == "a":
                depth = max(0, depth + (-1 if closes else 1))
        elif not closes and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            if tag == "textarea":
                held.append(" ")
        elif tag in VOID:
            flush()
        elif closes:
            flush()
            depth = 0
            names = [t for t, _ in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
        else:
            flush()
            depth = 0
            if tag in CLOSED_BY_LIKE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSED_BY_LIKE[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES:
                        break
            elif stack and stack[-1][0] == "p" or tag == "p" and any(t == "p" for t, _ in stack):
                k = max(i for i, (t, _) in enumerate(stack) if t == "p")
                if not any(t in SCOPES for t, _ in stack[k + 1 :]):
                    del stack[k:]
            stack.append((tag, _step(tag, m[3])))
    flush()
    return out


def path_scores(found: list[tuple], labelled: float = 0.001, further: float = 0.7) -> dict[tuple, float]:
    """The fused score of each path of blocks(); `labelled` is the weight of what the author's labels set apart, `further` that of a container one step further out."""
    sums: dict[tuple, list] = {}
    for path, apart, label, text, links in found:
        if not apart:
            s = sums.setdefault((path, label), [0, 0, 0, 0])
            for k, n in enumerate((1, len(text) - links, len(PUNCTUATION.findall(text)), links)):
                s[k] += n
    own = {p: text / n * (1 + log1p(points / n)) * text / max(1, text + links) for p, (n, text, points, links) in sums.items()}
    mass: dict[tuple, float] = {}
    inside: dict[tuple, list] = {}
    for (path, label), (_, text, points, _) in sums.items():
        weight = labelled if label else 1.0
        mass[path[:-1]] = mass.get(path[:-1], 0.0) + weight * text * (1 + log1p(points))
        inside.setdefault(path[:-1], []).append(weight * own[path, label])
    out = {}
    for (path, label), (_, text, _, links) in sums.items():
        around = [path[:k] for k in range(max(0, len(path) - 1), -1, -1) if path[:k] in mass]
        heavy, container = max(((mass[a] * further ** (len(path) - 1 - len(a)), a) for a in around), key=lambda x: x[0])
        smooth = (own[path, label] + sum(inside[container]) / len(inside[container])) / 2
        out[path, label] = sqrt(smooth * heavy) * text / max(1, text + links) * (labelled if label else 1.0)
    return out


def main_text(page: str | None, share: float = 0.15) -> str:
    """Content blocks in page order, joined by line feeds: those of paths whose score is at least `share` of the best. Without any path but labelled ones, none."""
    found = blocks(page or "")
    scores = path_scores(found)
    best = max((v for (_, label), v in scores.items() if not label), default=0.0)
    return "\n".join(text for path, apart, label, text, _ in found if not apart and 0 < best and scores[path, label] >= share * best)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=SCHEMA)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars; one pass, no shuffle.

    Null and empty pages, and pages without content: an empty text. Markup that breaks off or is not
    closed ends where its container ends. Very long pages: read once from start to end, in the memory of
    the page. Repeated rows: each is returned. An empty table: no rows. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
