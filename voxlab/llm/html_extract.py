"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides each
block by the share of stop words, its length and the share of its characters
that stand in links: much link text is boilerplate, long text with stop words is
main text, short text without links stays undecided.  In the second pass
undecided blocks take the label of the nearest decided block before and after them
(main text if both are, and otherwise the label of the nearer one, the same
section first).  Sections that mark themselves up as menus, headers, footers,
sidebars, notices, adverts, forms or comments are boilerplate as a whole;
where a page marks up its article, the text in it is main unless such a section.
A class or id alone is weaker: a wrapper so named that holds the page's article, or half of
the text of a page without one, is its layout and the block rules decide in it.

Stop words are the ``STOP_WORDS`` words that stand in the prose of most pages (runs of text of
``PROSE`` characters and more, without scripts, styles, references and addresses), so no list per
language is needed.  A page whose language has too few of them is told by its other features.

Defined results: a null or empty page, or one without main text, gives an
empty text; of two decided neighbours at equal distance the one before counts; unclosed tags and comments end with the page; unknown character
references stay as they are; repeated rows are extracted row by row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_WORDS, LONG, SHORT, STOP_HIGH, STOP_LOW, LINKED, PROSE = 400, 200, 70, 0.30, 0.15, 0.35, 60

# Names of HTML elements and of page sections.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul
    """.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noframes noembed xmp template textarea title svg canvas audio video select button".split())
OUT = frozenset("head nav footer aside form menu dialog header".split())
MAIN = frozenset("article main".split())
CELLS = frozenset("td th caption tr".split())
SECTION = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|popup|modal|"
    r"overlay|nav|navbar|navigation|menu|submenu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|related|recommended|share|sharing|social|follow|"
    r"newsletter|subscribe|signup|login|search|comment|comments|disqus|respond|replies|reply|footer|foot|header|masthead|topbar|toolbar|skip|"
    r"copyright|legal|pagination|pager|tags|tagcloud|meta|byline)(?:$|[\s_-])", re.I)
#: Of these, class or id tokens that name a section for certain where they stand alone: an article's own parts
#: are called legal-analysis, tags-explained or meta as well.
CERTAIN = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal overlay nav navbar
    navigation menu submenu breadcrumb breadcrumbs sidebar widget related recommended share sharing social newsletter subscribe comment comments disqus
    respond replies pagination pager tagcloud cookie-notice cookie-banner related-posts share-buttons comment-list comments-area""".split())
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


class Block:
    """Text between two block-level tags and where it stood."""
    __slots__ = ("article", "cell", "heading", "linked", "named", "out", "section", "text")

    def __init__(self, text: str, linked: int, out: bool, article: bool, section: int, heading: bool, named: tuple[int, ...], cell: bool = False):
        self.text, self.linked, self.out, self.article, self.section, self.heading, self.named, self.cell = text, linked, out, article, section, heading, named, cell


def _boilerplate(name: str, attributes: str, article: bool) -> int:
    """2 for a section that is no text, 1 for one that only a class or id says so of, else 0.

    Within an article a class or id must be one of ``CERTAIN`` as a whole."""
    if name in OUT:
        return 2
    named = 0
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and (not CERTAIN.isdisjoint(value.lower().split()) if article else SECTION.search(value)) or key == "role" and value.lower() in ROLE:
                if name in ("body", "html", "article", "main"):
                    return 0
                if key == "role":
                    return 2
                named = 1
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2
            if key == "hidden" and "=" not in m[0]:
                return 2
    return named


def _layout(found: list[Block], holders: set[int]) -> set[int]:
    """Of the wrappers named like a section by class or id, those that hold the page's main part."""
    size: Counter = Counter()
    for b in found:
        if not b.out:
            for w in b.named:
                size[w] += len(b.text)
    whole, kept = sum(len(b.text) for b in found if not b.out), set()

    def marked() -> bool:
        return any(b.article and not b.out and kept.issuperset(b.named) for b in found)

    for w in sorted(holders & size.keys(), key=lambda w: (-size[w], w)):
        if 2 * size[w] >= whole or not marked():
            kept.add(w)
    if not marked():
        kept |= {w for w in size if 2 * size[w] >= whole}
    return kept


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order, white space made single spaces, empty ones left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = []  # element, boilerplate, article, section, wrappers named like one
    holders: set[int] = set()  # those wrappers that hold an article
    pieces: list[str] = []
    linked: list[str] = []
    link, sections, heading, pos, end = 0, 0, False, 0, len(page)

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            in_links = len(SPACE.sub(" ", html.unescape("".join(linked))).strip())
            _, off, article, section, named = stack[-1] if stack else ("", False, False, 0, ())
            out.append(Block(text, in_links, off, article, section, heading, named, bool(stack) and stack[-1][0] in CELLS))
        pieces.clear()
        linked.clear()

    while pos < end:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos:
            pieces.append(page[pos:stop])
            if link:
                linked.append(page[pos:stop])
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = over.end() if over else end
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br" or name == "img":
            pieces.append(" ")
        elif name in BLOCKS or name == "head":
            close()
            link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                heading = False
            elif name not in VOID:
                if name in ("p", "li", "dd", "dt", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] == name:
                    stack.pop()
                elif name not in ("p",) and stack and stack[-1][0] == "p":
                    stack.pop()
                _, off, article, section, named = stack[-1] if stack else ("", False, False, 0, ())
                # a header within an article may hold its title; a page's own header doesn't
                bad = 0 if name == "header" and article else _boilerplate(name, attributes, article)
                if bad or name in MAIN or name in ("section", "div", "td", "body"):
                    sections += 1
                    section = sections
                if bad == 1:
                    named = (*named, sections)
                if name in MAIN and not off:
                    holders.update(named)
                stack.append((name, off or bad == 2, article or name in MAIN, section, named))
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    if any(b.named for b in out):
        kept = _layout(out, holders)
        for b in out:
            b.out = b.out or not kept.issuperset(b.named)
    return out


def _known(found: list[Block], stop: frozenset[str]) -> bool:
    """Whether the stop words are those of the page's language: its blocks hold many of them as a whole."""
    words = [w for b in found if not b.out and b.linked <= LINKED * len(b.text) for w in WORD.findall(b.text.lower())]
    return sum(w in stop for w in words) >= STOP_HIGH * max(1, len(words))


def decided(b: Block, stop: frozenset[str], marked: bool, known: bool = False) -> bool | None:
    """First pass: True for main text, False for boilerplate, None where the block is too short to tell.

    ``known``: the page's language has its stop words, so a long block without them is a list or a table of names."""
    if b.out:
        return False
    if marked and not b.article:
        return False
    n = len(b.text)
    links = b.linked / n
    if links > LINKED and (n > 20 or links > 0.9):
        return False
    if marked and b.cell:
        return True  # a table belongs to its article, however short its cells
    found = WORD.findall(b.text.lower())
    share = sum(w in stop for w in found) / len(found) if found else 0.0
    if n < SHORT or b.heading:
        return None
    if share >= STOP_HIGH or marked and links < 0.2:
        return True
    if share >= STOP_LOW:
        return True if n > LONG else None
    return None if n <= LONG else bool(marked or found and not known)


def main_text(page: str | None, stop: frozenset[str]) -> str:
    """The main text, one line per block."""
    found = blocks(page)
    marked = any(b.article and not b.out for b in found)
    known = not marked and _known(found, stop)
    label = [decided(b, stop, marked, known) for b in found]
    before, after = [None] * len(found), [None] * len(found)
    at = None
    for i, x in enumerate(label):
        before[i] = at
        if x is not None:
            at = i
    at = None
    for i in range(len(found) - 1, -1, -1):
        after[i] = at
        if label[i] is not None:
            at = i
    out = []
    for i, b in enumerate(found):
        x = label[i]
        if x is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            # nearest decided blocks, those of the block's own section first
            near.sort(key=lambda j: (found[j].section != b.section, abs(j - i)))
            x = label[near[0]] if near else True
            if marked and near and found[near[0]].article != b.article:
                x = True  # nothing decided stands in the article with it
            if marked and near and not found[near[0]].article:
                x = True
            if not marked and b.heading and after[i] is not None:
                x = label[after[i]]  # a title belongs to what it stands over
        if x:
            out.append(b.text)
    return "\n".join(out)


NO_PROSE = re.compile(r"<(script|style|noscript|svg|template|textarea|title|select)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
INLINE = re.compile(r"</?(?:a|abbr|b|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|u)(?=[\s/>])[^>]*>", re.I)
ADDRESS = re.compile(r"\S*(?:://|www\.|@)\S*")


def prose(page: str | None) -> str:
    """The long runs of text of a page."""
    runs = (r for r in re.split(r"<[^>]*>", INLINE.sub("", NO_PROSE.sub(" ", page or ""))) if len(r) >= PROSE)
    return "\n".join(html.unescape(ADDRESS.sub(" ", r) if "://" in r or "www." in r or "@" in r else r) for r in runs)


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
    found: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            found.update(set(WORD.findall(prose(t.as_py()).lower())))
        if len(found) > 500_000:
            yield out(found)
            found.clear()
    yield out(found)


def stop_words(pages: DataFrame, html_col: str = "html", size: int = STOP_WORDS) -> frozenset[str]:
    """The words in most pages; as many as ``size``."""
    counted = pages.select(F.col(html_col).cast("string")).mapInArrow(_page_words, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(size)
    return frozenset(r[0] for r in top.select("word").collect())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    stop = stop_words(pages, html_col)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t.as_py(), stop) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long") \
        .withColumnsRenamed({"page_id": id_col, "url": url_col})
