"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of tags and of text between them. Every word scores the weight of
its context and every tag a negative weight; one linear scan finds the contiguous run of
the highest sum, which is widened to the element or blocks it stands in. The weights are
log odds counted on pages that mark their article themselves (the labelled pages).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import slices, smallest_hashes, table

#: Bound of the labelled pages that the weights are counted on.
LABELLED_PAGES = 2000

#: Fixed lists: elements that never hold main text, and those that begin and end a block.
SILENT = frozenset("head script style noscript template iframe object svg canvas math nav aside form footer button select textarea dialog".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|select"
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Fixed list: words of class, id and role that name what surrounds an article.
ASIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent
    contentinfo cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification pagination pager popup promo
    promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
#: Names that mean the page's surroundings only outside the article.
OUTER_NAMES = frozenset("header banner alert notice".split())
#: Fixed list: words that say nothing of a name's meaning beside one of the above ("share-buttons").
PLAIN_NAMES = frozenset("""area articles bar block body bottom box button buttons card container content form group holder inline inner item items left link links list
    main outer page panel post posts right row section signup slot stories top unit wrap wrapper""".split())
#: Fixed lists: elements whose end tag may be left out, the start tags that end them, and the elements that keep them open.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
            "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
KEPT_OPEN_BY = {"p": (), "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

#: Inside a tag "<" stands in quotes only, and nothing is tried twice: unclosed tags take linear time and are text.
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
                   r"""|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)""", re.S | re.I)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|type)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")

#: Weights where no page is labelled: of a word by context, of a tag by kind.
DEFAULT_WEIGHTS = {"word:text": 1.0, "word:heading": 0.5, "word:item": 0.2, "word:link": -1.0, "word:aside": -3.0,
                   "tag:block": -1.0, "tag:inline": -0.3, "tag:link": -3.0, "tag:aside": -6.0}
#: Least amount by which words outside links and asides count for, and tags against, a run.
LEAST = 0.05


class Item:
    __slots__ = ("kind", "name", "text", "words", "aside", "main", "block", "doubt")

    def __init__(self, kind: str, name: str, text: str, words: int, aside: bool, main: int, block: bool, doubt: int):
        self.kind, self.name, self.text, self.words, self.aside, self.main, self.block, self.doubt = kind, name, text, words, aside, main, block, doubt


class Element:
    """An open element, followed tag by tag up to its end: its end tag, a start tag that implies it, or the end of what it stands in."""

    def __init__(self, name: str, around: Counter):
        self.name, self.around, self.depth, self.within = name, Counter(around), 1, Counter()

    def after(self, name: str, closing: bool, attrs: str) -> str:
        """Whether a tag is in the element ("in"), ends it ("last") or stands behind it ("behind")."""
        if closing:
            if name == self.name:
                self.depth -= 1
                return "in" if self.depth else "last"
            if self.within[name]:
                self.within[name] -= 1
            elif self.around[name]:
                return "behind"
        elif name in ENDED_BY.get(self.name, ()) and not any(self.within[x] for x in KEPT_OPEN_BY[self.name]):
            return "behind"
        elif name == self.name:
            self.depth += not attrs.rstrip().endswith("/")
        elif name in BLOCKS and name not in VOID:
            self.within[name] += 1
        return "in"


def aside_name(attrs: str, name: str, in_main: bool) -> str:
    """What class, id and role say of an element: "aside", "doubt" (the score decides) or ""."""
    found = ""
    for m in NAMED.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "aside"
        if key not in ("class", "id", "role"):
            continue
        for token in value.split()[:1] if name in MAIN else value.split():   # what an article is, its first name says
            parts = NAME_PART.findall(token)
            named = [p for p in parts if p in ASIDE_NAMES and not (in_main and p in OUTER_NAMES)]
            if not named:
                continue
            if not in_main and name not in MAIN or all(p in named or p in PLAIN_NAMES for p in parts):
                return "aside"
            found = "" if name in MAIN else "doubt"
    return found


def items_of(page: str) -> list[Item]:
    """Tags and texts of a page in order.

    main: number of the outermost article or main element around, 0 for none; doubt: number of
    the element around that a part of its name would make an aside, 0 for none.
    """
    out: list[Item] = []
    silent: Element | None = None                     # the aside that is open
    doubted: Element | None = None
    around: Counter = Counter()                       # open blocks outside asides
    link = heading = item = 0
    mains, main, depth, at, doubts, doubt = 0, 0, 0, 0, 0, 0

    def text(raw: str) -> None:
        words = " ".join(html.unescape(raw).split()) if raw else ""
        if words or raw[:1].isspace() or raw[-1:].isspace():
            kind = "aside" if silent else "link" if link else "heading" if heading else "item" if item else "text"
            spaced = (" " if raw[:1].isspace() else "") + words + (" " if raw[-1:].isspace() and words else "")
            out.append(Item("word", kind, spaced, words.count(" ") + 1 if words else 0, bool(silent), main, False, doubt))

    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing, block = bool(m["close"]), name in BLOCKS
        last = False
        if doubted:
            is_now = doubted.after(name, closing, m["attrs"])
            last = is_now == "last"
            if is_now == "behind":
                doubted, doubt = None, 0
        if silent:
            is_now = silent.after(name, closing, m["attrs"])
            if is_now != "in":
                silent = None
            if is_now != "behind":
                out.append(Item("tag", "aside", "", 0, True, main, block, doubt))
                if last:
                    doubted, doubt = None, 0
                continue
        if closing:
            around[name] -= around[name] > 0
            if name in MAIN and depth:
                depth -= 1
        elif name not in VOID:
            said = "" if name in KEPT and name != "article" else aside_name(m["attrs"], name, bool(main))
            if name in SILENT or name == "header" and not main or said == "aside":
                silent = Element(name, around)
                out.append(Item("tag", "aside", "", 0, True, main, block, doubt))
                continue
            if said and not doubted:
                doubts += 1
                doubted, doubt = Element(name, around), doubts
            if block and name not in ENDED_BY:
                around[name] += 1
            if name in MAIN:
                depth += 1
                if not main:
                    mains += 1
                    main = mains
        if name == "a":
            link = 0 if closing else 1
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if closing else 1
        elif name == "li":
            item = 0 if closing else 1
        kind = "link" if name == "a" else "block" if block else "inline"
        out.append(Item("tag", kind, " " if name == "br" else "", 0, False, main, block, doubt))
        if last:
            doubted, doubt = None, 0
        if closing and name in MAIN and not depth:
            main = 0
    text(page[at:])
    return out


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """Start and end of the contiguous run of the largest sum; the first and shortest of equal ones, None if no sum is above 0."""
    best, total, start, found = 0.0, 0.0, 0, None
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def leads(x: Item) -> bool:
    """Whether an item right before a run belongs to it: a heading, white space, or a tag that is no link."""
    return not x.aside and (x.name not in ("link", "aside") if x.kind == "tag" else x.name == "heading" or not x.words)


def main_text(page: str, weights: dict[str, float]) -> str:
    """The article's blocks joined by blank lines.

    Of several articles of a page those stay that the run covers at least half of. A part of an
    article whose name only sounds like an aside ("share-price") stays if it scores above 0.
    """
    items = items_of(page)
    scores = [weights[f"word:{x.name}"] * x.words if x.kind == "word" else weights[f"tag:{x.name}"] for x in items]
    run = best_run(scores)
    if run is None:
        return ""
    start, end = run
    held, total, doubts = Counter(), Counter(), Counter()
    for i, (x, score) in enumerate(zip(items, scores)):
        if x.doubt:
            doubts[x.doubt] += score
        if x.kind == "word" and not x.aside:
            total[x.main] += x.words
            if start <= i < end:
                held[x.main] += x.words
    inside = held.most_common(1)[0][0] if held else 0
    if inside:                                        # the whole of the articles that the run stands in
        mains = {k for k, n in held.items() if k and 2 * n >= total[k]} | {inside}
        chosen = [x for x in items if x.main in mains]
    else:
        while start and (leads(items[start - 1]) or not items[start].block):
            start -= 1                                # back to the edge of the block, and over headings right before
        while end < len(items) and not items[end].block:
            end += 1
        chosen = items[start:end]
    blocks, part = [], []
    for x in chosen:
        if x.block:
            blocks.append("".join(part))
            part = []
        elif not x.aside and (not x.doubt or doubts[x.doubt] > 0):
            part.append(x.text)
    blocks.append("".join(part))
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def fitted_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of each context inside an article against outside it, over `most` labelled pages at most.

    Labelled is a page with an <article>; which ones are taken depends on a hash of the id.
    Words of running text keep a positive weight and tags a negative one. A context that
    the sample doesn't show has its default weight.
    """
    page = F.col(html_col).cast("string")
    labelled = pages.filter(page.contains("<article")).select(page.alias("_html"), F.col(id_col).cast("string").alias("_id"))
    sample = smallest_hashes(labelled, F.col("_id"), most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("_html").to_pylist():
                for x in items_of(text):
                    seen[f"{x.kind}:{x.name}", bool(x.main) and not x.aside] += x.words if x.kind == "word" else 1
        yield pa.RecordBatch.from_pydict({"context": [k for k, _ in seen], "inside": [i for _, i in seen], "n": list(seen.values())}, schema)

    schema = pa.schema([("context", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])
    found = {(r.context, r.inside): r.n for r in sample.mapInArrow(counted, "context string, inside boolean, n long")
             .groupBy("context", "inside").agg(F.sum("n").alias("n")).collect()}       # a few contexts, whatever the pages
    weights = dict(DEFAULT_WEIGHTS)
    for kind in ("word", "tag"):
        total = {i: sum(n for (c, x), n in found.items() if x == i and c.startswith(kind)) for i in (True, False)}
        if not total[True] or not total[False]:
            continue
        for c in DEFAULT_WEIGHTS:
            n = {i: found.get((c, i), 0) for i in (True, False)}
            if c.startswith(kind) and n[True] + n[False]:
                odds = math.log((n[True] + 1) / (total[True] + 2)) - math.log((n[False] + 1) / (total[False] + 2))
                text = c in ("word:text", "word:heading")
                weights[c] = max(LEAST, odds) if text else min(-LEAST, odds) if kind == "tag" else odds
    return weights


def extracted(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, and one without a run of positive score, has the empty text.
    Rows stay as they are, repeated ones and those without an id or url too; other columns
    are not read; an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = [main_text(t, weights) for t in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fitted_weights(pages))
