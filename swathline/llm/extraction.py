"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with the path of tags from the root to its element. For every path the length of
its texts and their punctuation are aggregated and related to the number of its blocks. These ratios are smoothed over
the blocks next to each other in the page, and fused with the ratios of the enclosing path, so that a heading or a short
paragraph inside an article shares in what the article holds. Paths above a threshold of the page's own scores are
content. Paths through elements that never hold the article (navigation, forms, scripts) score zero. A class, id or role
that names a notice, advert, menu, sidebar or reader comment lowers the scores of its element's paths to the share of the
page's text and punctuation that the element holds, unless that is most of both; html, body, main and article aren't judged
by such names, and hyphenated names count as a whole or by their first part before "notice", "banner" and the like.

All blocks of a content path are kept, in page order. Null or empty html, or a page without content: empty text. Broken
markup (tags that are never closed, stray closing tags, a cut-off page) is read as far as it goes. Repeated rows are
extracted each for itself. Extra columns are ignored. A page is held by one task; nothing is shuffled.
"""

from __future__ import annotations

import html as references
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import map_batches

# Element names of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template iframe svg math nav footer aside form button select option textarea "
    "input menu dialog object embed canvas audio video".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
BOUNDS = frozenset("ul ol dl table select body html article section div main aside nav".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promoted related "
    "reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: Names of which the first part says what the element holds, such as cookie-notice or comment-list.
_COMPOUND = re.compile(
    r"(?:%s)[-_](?:area|banner|bar|block|box|container|form|item|list|links|menu|notice|popup|section|unit|widget|wrapper)"
    % "|".join(sorted(BOILERPLATE))
)
#: The share of the page's unbarred text that the content right under a path has if the path is a trunk.
TRUNK = 0.25
#: Elements that a label doesn't lower.
HOLDERS = frozenset(("html", "body", "main", "article"))


@dataclass
class _Open:
    name: str
    path: str
    barred: bool
    labels: tuple[int, ...] = ()


@dataclass
class _Paths:
    """What is known of one tag path in a page."""

    length: int = 0
    marks: int = 0
    blocks: int = 0
    places: list[int] = field(default_factory=list)


def _barred(name: str, inside_article: bool) -> bool:
    return name in NEVER or name == "header" and not inside_article


def _labelled(name: str, attributes: str) -> bool:
    if name in HOLDERS:
        return False
    for kind, *values in _LABEL.findall(attributes):
        names = "".join(values).lower().split()
        if kind.lower() == "role":
            if ROLES.intersection(names):
                return True
        elif any(n in BOILERPLATE or _COMPOUND.fullmatch(n) for n in names):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, bool, str, tuple[int, ...]]]:
    """(path, barred, text, labelled elements around it) of every text block in page order."""
    out: list[tuple[str, bool, str, tuple[int, ...]]] = []
    labelled = 0
    stack = [_Open("", "", False)]  # html and body are implied in all paths
    held: list[str] = []
    home = stack[0]

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((home.path if home.path not in ("", "/html") else "/html/body", home.barred, text, home.labels))

    def block() -> _Open:
        return next(o for o in reversed(stack) if o.name not in INLINE)

    def write(text: str) -> None:
        nonlocal home
        if not held:
            home = block()
        held.append(text)

    def close(names, bounds) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                flush()
                del stack[i:]
                return
            if stack[i].name in bounds:
                return

    position, end = 0, len(page)
    while position < end:
        match = _TOKEN.search(page, position)
        stop = match.start() if match else end
        if stop > position:
            write(page[position:stop])
        if not match:
            break
        position = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name not in INLINE:
                flush()
                close((name,), ())
            elif any(o.name == name for o in stack):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i]
                        break
                    if stack[i].name not in INLINE:
                        break
            continue
        if name in VOID:
            if name in INLINE:
                if name == "br":
                    held.append(" ") if held else None
            else:
                flush()
            continue
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, position)
            position = shut.end() if shut else end
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_PARAGRAPH:
                close(("p",), BOUNDS)
                while len(stack) > 1 and stack[-1].name in INLINE:
                    stack.pop()
            if name in SAME_LEVEL:
                close(SAME_LEVEL[name], BOUNDS)
        above = stack[-1]
        if name in ("html", "head", "body"):
            holder = "/html" if name != "html" else ""
        else:
            holder = "/html/body" if above.path in ("", "/html") else above.path
        inside = any(o.name in ("article", "main") for o in stack)
        barred, labels = above.barred or _barred(name, inside), above.labels
        path = above.path if name in INLINE else f"{holder}/{name}"
        if _labelled(name, match[3]):
            if name in INLINE:
                barred = True
            else:
                labelled += 1
                labels = (*labels, labelled)
        stack.append(_Open(name, path, barred, labels))
        if barred and name in INLINE and held:
            flush()
    flush()
    return out


def _ratio(paths: _Paths) -> float:
    """Text length by block, weighted by punctuation by block."""
    return paths.length / paths.blocks * (1 + paths.marks / paths.blocks)


def content(found: list[tuple[str, bool, str, tuple[int, ...]]], reach: int = 2, share: float = 0.5) -> list[str]:
    """The texts whose path scores above the threshold."""
    # What a labelled element holds of the page's text and punctuation; one that holds most of both counts as unlabelled.
    # Where an article or main element has text of its own, labelled elements outside of such elements score zero.
    within = [not {"article", "main"}.isdisjoint(path.split("/")) for path, *_ in found]
    named = any(w and not barred and not labels for w, (_, barred, _, labels) in zip(within, found))
    held_in = {i for w, (*_, labels) in zip(within, found) if w for i in labels}
    sums: dict[int, list[int]] = {0: [0, 0]}
    for _, barred, text, labels in found:
        if not barred:
            marks = len(_PUNCTUATION.findall(text))
            for label in (0, *labels):
                s = sums.setdefault(label, [0, 0])
                s[0], s[1] = s[0] + len(text), s[1] + marks
    shares = {i: (s[0] / (sums[0][0] or 1), s[1] / (sums[0][1] or 1)) for i, s in sums.items()}
    lowered = {i: a * b for i, (a, b) in shares.items() if a <= 0.5 or b <= 0.5}
    lowered |= {i: 0.0 for i in shares if i and named and i not in held_in}
    factors = [math.prod(lowered.get(i, 1.0) for i in labels) for *_, labels in found]
    # Lowered elements don't shape the page's own scores, but theirs are held against the same threshold.
    blocks = [(path, barred or f < 1, text) for (path, barred, text, _), f in zip(found, factors)]
    kept, threshold = _kept(blocks, reach, share)
    parts: dict[tuple, _Paths] = {}
    for (path, barred, text, labels), f in zip(found, factors):
        if not barred and f < 1:
            s = parts.setdefault((path, labels), _Paths())
            s.length, s.marks, s.blocks = s.length + len(text), s.marks + len(_PUNCTUATION.findall(text)), s.blocks + 1
    out = []
    for (path, barred, text, labels), f in zip(found, factors):
        if not barred and (path in kept if f == 1 else f > 0 and _ratio(parts[path, labels]) * (1 + shares[labels[-1]][0]) * f >= threshold):
            out.append(text)
    return out


def _kept(blocks: list[tuple[str, bool, str]], reach: int, share: float) -> tuple[set[str], float]:
    """The paths that score above the threshold, and the threshold."""
    stats: dict[str, _Paths] = {}
    subtree: dict[str, _Paths] = {}
    for place, (path, barred, text) in enumerate(blocks):
        if barred:
            continue
        marks = len(_PUNCTUATION.findall(text))
        own = stats.setdefault(path, _Paths())
        own.places.append(place)
        above = path.rpartition("/")[0]
        for s in (own, subtree.setdefault(above, _Paths())):
            s.length, s.marks, s.blocks = s.length + len(text), s.marks + marks, s.blocks + 1
    if not stats:
        return set(), 0.0
    raw = {path: _ratio(s) for path, s in stats.items()}
    around = [math.exp(-((d / reach) ** 2) / 2) for d in range(-reach, reach + 1)]
    series = [0.0 if barred else raw[path] for path, barred, _ in blocks]
    smooth: dict[str, float] = {}
    for path, s in stats.items():
        total = weight = 0.0
        for place in s.places:
            for step, w in zip(range(-reach, reach + 1), around):
                if 0 <= place + step < len(series):
                    total, weight = total + w * series[place + step], weight + w
        smooth[path] = total / weight
    # A path is fused with its enclosing path, by how much of the page's text that one holds.
    whole = sum(s.length for s in stats.values())
    scores = {}
    for path in stats:
        holder = subtree[path.rpartition("/")[0]]
        scores[path] = smooth[path] + _ratio(holder) * holder.length / whole
    mean = sum(scores[p] * s.length for p, s in stats.items()) / whole
    threshold = share * mean
    # A path whose own content holds enough of the page's text is a trunk: lists, tables and headings under it are kept too.
    direct: dict[str, int] = {}
    for p, s in stats.items():
        if scores[p] >= threshold:
            above = p.rpartition("/")[0]
            direct[above] = direct.get(above, 0) + s.length
    trunks = [t for t, length in direct.items() if length >= TRUNK * whole]
    kept = {p for p in stats if scores[p] >= threshold or any(p.startswith(t + "/") for t in trunks)}
    return kept, threshold


def main_text(page: str | None) -> str:
    return "\n\n".join(content(blocks_of(page))) if page else ""


def extract(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text"
) -> DataFrame:
    """The kept columns, the main text and its length in code points, one row per page."""
    source = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{text_col}` string, n_chars bigint"

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [main_text(p) for p in batch.column("_html").to_pylist()]
            return {c: batch.column(c) for c in keep} | {text_col: texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_batches(source, schema, make)
