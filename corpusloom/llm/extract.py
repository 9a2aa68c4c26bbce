"""Main text of web pages by the distribution of text over line blocks.

A page is cut into lines at block-level tags; each line knows its text, how much
of it stands in links, and which markup holds it. Boilerplate markup is stripped
with its text. Every remaining line has a weight: its length without links, more
inside of prose elements and of an article's element, less outside of that element
where a page has one. Weights are summed over windows that look ahead and back. The
text starts at the first line that carries a window whose sum surges and ends at the
last one before the sums dive for good. Lines in between are kept whole, however
short or linked they are.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, LINK_SHARE = 3, 80, 0.6
#: Least weight of a line that starts or ends the text; what prose elements and an article's
#: element add to a weight; the part of a weight that counts outside of that element.
CARRY, PROSE_BONUS, HOLDER_BONUS, OUTER = 20, 40, 40, 0.25
# Elements whose text is never shown or never part of an article, those
# that hold an article, and those inside of a line.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
HOLDERS = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Their ids are slugs of titles inside of an article.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6 p".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|rail|topbar|footer|foot|copyright|legal|comment|comments|disqus|replies|respond|discussion|"
    r"related|recommended|recommendations|trending|popular|share|sharing|social|follow|newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|toolbar|skip)(?:$|[-_\s])",
    re.I,
)
#: Noise only outside of an article, whose own header holds its title.
HEADER = re.compile(r"(?:^|[-_\s])(?:header|masthead|head)(?:$|[-_\s])", re.I)
ABSENT = re.compile(r"\b(?:no|has|with|without|hide|hides)[-_]\S+", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# A quote opens a value only behind an equals sign; elsewhere it is a plain character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|</?[A-Za-z](?:[^>]*)\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


def _noisy(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate. ``inside``: an article holds it."""
    if tag in HIDDEN or tag in OUTSIDE or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("body", "html") or tag in HOLDERS:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "id" and inside and tag in TITLED:
            continue
        if name in ("class", "id"):
            names = ABSENT.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", value))
            if NOISE.search(names) or (not inside and HEADER.search(names)):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """Lines outside of boilerplate: text, characters of it in links, held by an article, by prose."""
    out: list[tuple[str, int, bool, bool]] = []
    words: list[str] = []
    linked = links = holders = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, holder
    noise = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            block = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
            out.append((text, min(linked, len(text)), holders > 0, block in PROSE))
        words.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not noise:
            words.append(page[at:stop])
            if links:
                linked += len(" ".join(html.unescape(page[at:stop]).split()))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            if not noise:
                words.append(html.escape(m[0][9:-3]))
            continue
        if not m[2]:
            continue
        tag, close = m[2].lower(), bool(m[1])
        if tag not in INLINE and not noise:
            flush()
        if tag == "a" and not close:
            links = 1
        elif tag == "a":
            links = 0
        if close:
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, bad, holder = stack.pop()
                    noise -= bad
                    holders -= holder
                    if t == tag:
                        break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in _RAW:
            last = _RAW[tag].search(page, at)
            at = last.end() if last else end
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            # These end where the next one of them opens in the same parent.
            while stack and stack[-1][0] in ("p", tag):
                _, bad, holder = stack.pop()
                noise -= bad
                holders -= holder
        bad = _noisy(tag, m[3], holders > 0)
        if bad and tag in INLINE and not noise:
            words.append(" ")
        stack.append((tag, bad, tag in HOLDERS))
        noise += bad
        holders += tag in HOLDERS
    flush()
    return out


def weights(lines: list[tuple[str, int, bool, bool]]) -> list[float]:
    """Weight of each line; 0 for short lines that are links for the most part."""
    article = any(inside for _, _, inside, _ in lines)
    out = []
    for text, linked, inside, prose in lines:
        if linked >= LINK_SHARE * len(text) and len(text) <= 4 * SURGE:
            out.append(0.0)
        else:
            n = len(text) - linked + (PROSE_BONUS if prose else 0)
            out.append(n + HOLDER_BONUS if inside else n * OUTER if article else float(n))
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text: its lines from the surge to the dive, joined by spaces."""
    lines = lines_of(page or "")
    every = weights(lines)
    # Lines of links count only for what lies outside of the range.
    texts = [i for i, n in enumerate(every) if n > 0]
    sizes = [every[i] for i in texts]
    sums = [0.0]
    for n in sizes:
        sums.append(sums[-1] + n)
    ahead = [sums[min(len(sizes), i + window)] - sums[i] for i in range(len(sizes))]
    behind = [sums[i + 1] - sums[max(0, i + 1 - window)] for i in range(len(sizes))]
    first = next((i for i, n in enumerate(ahead) if n >= surge and sizes[i] >= CARRY), None)
    last = next((i for i in reversed(range(len(sizes))) if behind[i] >= surge and sizes[i] >= CARRY), None)
    if first is None or last is None or last < first:
        # No window surges: a page as short as this has no other text.
        return " ".join(lines[i][0] for i in texts)
    inside = lambda k: lines[texts[k]][2]
    # One short line alone beside the text is its title or its close; several are a menu.
    if first == 1 and inside(0) == inside(1):
        first = 0
    if last == len(texts) - 2 and inside(last) == inside(last + 1):
        last += 1
    article = any(x[2] for x in lines)
    kept = [i for i in range(texts[first], texts[last] + 1) if not article or lines[i][2] or every[i] >= surge]
    return " ".join(lines[i][0] for i in kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text. Each page is parsed whole in its task;
    nothing is shuffled. Repeated rows stay rows, and other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
