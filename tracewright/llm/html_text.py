"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass decides blocks by what encloses them (menus, forms,
adverts and the like are boilerplate), by link density, length and stop-word density; short ones without a clear sign
stay open. A run of blocks that are nearly text is text if it is long together. An article, or what names itself content,
shifts the thresholds: inside, only links speak against a block; beside one, nothing but a long run is text. In the second
pass open blocks take the label of their nearest decided neighbours; between two that differ, a sentence counts as text.
Beside an article, an article is no such neighbour.

Names are weights. One that only opens with a word of boilerplate ("share-price") counts against what holds no long run
of text; an article inside a form or what names itself search, header, advert and so on is an article all the same, if it
is the only one or holds such a run. Stop words judge a block only in their own script; elsewhere sentences stand in.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that this for with on as was are be by an or at from not have has he she they we you but which all one "
    "le la les de des du un une et est en que qui dans pour par sur pas au aux avec ce se il elle on ne plus son sa ses ou "
    "der die das und ist im in den von zu mit sich des auf für nicht ein eine als auch es an dem bei nach aus wie oder "
    "el los las y es en un una por con para no su del al lo como más pero sus o este".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
DROPPED = frozenset("script style noscript template textarea select svg iframe object canvas audio video head title map annotation annotation-xml".split())
OUTSIDE = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article articlebody content entry main maincontent post story".split())
#: Names of boilerplate, of which even an article inside is none (firm) or counts (open), and names of readers' comments.
FIRM = frozenset("advertisement advertising breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup related sidebar signup sponsor sponsored widget widgets".split())
OPEN = frozenset("ad ads adv advert adverts alert alerts announcement announcements banner header legal login masthead promo promoted search share sharing social subscribe toolbar topbar".split())
READERS = frozenset("comment comments disqus replies respond".split())
#: Words that begin names of other things too, and words that add nothing to the name before them.
LOOSE = frozenset("ad ads alert announcement banner header legal promo related search share sharing social subscribe".split())
PLAIN = frozenset("area articles bar block body box buttons container content entry form frame holder icons inner items label link links list main module panel posts row section slot space stories text unit wrap wrapper zone".split())
MARKS = string.punctuation + "«»“”„‘’…¿¡–—"
LINKS, SHORT, LONG, FEW, MANY = 0.33, 70, 200, 0.15, 0.30
HARD, SOFT, WEAK = 3, 2, 1

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|©\s*(?:19|20)[0-9]{2}", re.I)


def hinted(attributes: str) -> tuple[int, bool, bool]:
    """How much class, id and role speak for boilerplate, whether for content, and whether they name readers' comments.

    HARD for firm names, SOFT for those an article inside overrules, WEAK for a loose word that begins another name.
    "no-sidebar" says that there is none.
    """
    against, content, readers = 0, False, False
    for m in _NAMES.finditer(attributes):
        for token in m[1].strip("\"'").lower().split():
            words = [w for w in _SPLIT.split(token) if w]
            if not words or words[0] in ("no", "has", "with", "without"):
                continue
            content = content or words[-1] in CONTENT
            named = [w for w in words if w not in PLAIN] or words
            ends = {named[0], named[-1]}
            readers = readers or bool(ends & READERS)
            if len(named) > 1 and named[0] in LOOSE and named[-1] not in FIRM | OPEN | READERS:
                against = max(against, WEAK)
            elif ends & (FIRM | READERS):
                against = HARD
            elif ends & OPEN:
                against = max(against, SOFT)
    return against, content, readers


def blocks(page: str) -> Iterator[tuple[str, int, int, str]]:
    """Text, length of it inside links, place (-1 boilerplate, 1 article, 0 neither) and tag of each block.

    What only holds if there is a long run of text in it is decided when all of it is read.
    """
    # an entry of the stack: tag, place (-1 boilerplate but for articles, -2 but for the main part, -3 in any case), and
    # the question on which that rests (or -1)
    stack: list[tuple[str, int, int]] = []
    asked: list[tuple[int, bool]] = []  # of each question: the one around it, and whether an article asks it
    found: list[tuple[str, int, int, str, int]] = []
    text: list[str] = []
    linked, in_link, breaks = 0, False, 0
    place, tag, rests = 0, "", -1

    def flush() -> None:
        nonlocal linked
        block = " ".join(html.unescape("".join(text)).split())
        if block:
            found.append((block, linked, place, tag, rests))
        text.clear()
        linked = 0

    def add(run: str) -> None:
        nonlocal linked
        text.append(run)
        if in_link:
            linked += len("".join(html.unescape(run).split()))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            run = page[at : m.start()]
            breaks = breaks if run.isspace() else 0
            add(run)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
            continue
        if name in DROPPED:
            if not m[1] and not m[3].endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                if close:
                    at = page.find(">", close.start()) + 1 or end
                elif name not in ("head", "title", "map", "annotation", "annotation-xml"):
                    at = end
            continue
        if name in ("a", "button"):
            in_link = not m[1]
            continue
        if name not in BLOCKS:
            continue
        breaks = 0
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = False
        elif name not in VOID:
            if name in ("p", *HEADINGS):
                while stack and stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
            _, now, on = stack[-1] if stack else ("", 0, -1)
            if now > -3 and name not in ("html", "body"):
                against, content, readers = hinted(m[3]) if m[3] != ">" else (0, False, False)
                article = name == "main" or name == "article" and not readers
                if name in OUTSIDE or name == "header" and now == 0 or readers and not article:
                    now = -3
                elif against == HARD and not article:
                    now = -2
                elif article and (now > -2 or name == "main"):
                    if now < 0:
                        asked.append((on, True))
                        on = len(asked) - 1
                    now = 1
                elif now >= 0 and (name in ("form", "fieldset") or against == SOFT):
                    now = -1
                elif now >= 0:
                    now = 1 if content and name in ("div", "section", "td") else now
                    if against == WEAK:
                        asked.append((on, False))
                        on = len(asked) - 1
            stack.append((name, now, on))
        _, place, rests = stack[-1] if stack else ("", 0, -1)
        tag = stack[-2][0] if len(stack) > 1 and stack[-1][0] == "li" else stack[-1][0] if stack else ""
    flush()
    holds = [False] * len(asked)
    for block, links, where, _, q in found:
        if q >= 0 and where >= 0 and len(block) >= LONG and links <= LINKS * len(block) and spoken(block) >= FEW:
            while q >= 0 and not holds[q]:
                holds[q], q = True, asked[q][0]
    sure = any(where > 0 and q < 0 for _, _, where, _, q in found)
    stands: list[bool] = []
    for k, (around, article) in enumerate(asked):
        stands.append((holds[k] or article and not sure) and (around < 0 or stands[around]))
    for block, links, where, of, q in found:
        yield block, links, -1 if where < 0 or q >= 0 and not stands[q] else where, of


def spoken(text: str) -> float:
    """Share of stop words. Where they cannot tell, sentences stand in: MANY in another script, FEW in the same."""
    words = text.lower().split()
    share = sum(w.strip(MARKS) in STOP_WORDS for w in words) / len(words)
    if share >= FEW:
        return share
    letters = [c for c in text if c.isalpha()]
    if 2 * sum(c > "\u024f" for c in letters) > len(letters):
        return MANY
    plain = sum(w.strip(MARKS).isalpha() for w in words)
    return FEW if text[0].isupper() and text[-1] in ".!?…" and len(words) >= 8 and plain >= 0.9 * len(words) else share


def first_pass(text: str, linked: int, place: int, tag: str) -> int:
    """1 text, -1 boilerplate, 0 open, 2 nearly text."""
    size = len(text)
    density = linked / max(1, size - text.count(" "))
    if place < 0:
        return -1
    if place > 0:
        return 1 if size >= LONG or density <= LINKS or tag == "ol" else -1 if density > 0.9 else 0
    if density > LINKS or size < LONG and _RIGHTS.search(text):
        return -1
    if tag == "pre":
        return 0
    if size < SHORT:
        return -1 if linked else 0
    stop = spoken(text)
    return (1 if size > LONG else 2) if stop >= MANY else 2 if stop >= FEW else -1 if size > LONG else 0


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by empty lines."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    article = any(place > 0 for _, _, place, _ in found)
    marks = [first_pass(*block) for block in found]
    beside = [article and not place for _, _, place, _ in found]
    k = 0
    while k < len(marks):
        end = k + 1
        if found[k][2] == 0 and marks[k] >= 0:
            while end < len(marks) and found[end][2] == 0 and marks[end] >= 0:
                end += 1
            size = sum(len(found[i][0]) for i in range(k, end) if marks[i])
            if size > 2 * LONG:
                marks[k:end] = [m and 1 for m in marks[k:end]]
            elif beside[k]:
                marks[k:end] = [m and 2 for m in marks[k:end]]
        k = end
    known = [k for k, m in enumerate(marks) if m in (1, -1)]
    before, after, last = [0] * len(marks), [0] * len(marks), -1
    gap_b, gap_a = [0] * len(marks), [0] * len(marks)

    def label(k: int, of: int) -> int:
        return -1 if beside[k] and not beside[of] else marks[of]

    for k, m in enumerate(marks):
        before[k], gap_b[k] = (label(k, last), k - last) if last >= 0 else (-1, len(marks) + 1)
        last = k if m in (1, -1) else last
    last = -1
    for k in range(len(marks) - 1, -1, -1):
        after[k], gap_a[k] = (label(k, last), last - k) if last >= 0 else (-1, len(marks) + 1)
        last = k if marks[k] in (1, -1) else last
    out = []
    for k, (text, _, _, tag) in enumerate(found):
        m, heading = marks[k], tag in HEADINGS
        if m == 2:
            m = 1 if not known or before[k] == 1 or after[k] == 1 else -1 if len(text) < LONG or beside[k] else 1
        elif m == 0:
            m = after[k] if before[k] == after[k] or heading else before[k] if gap_b[k] < gap_a[k] else after[k] if gap_a[k] < gap_b[k] else 1 if text[-1] in ".!?" else -1
            m = 1 if not known and any(x == 2 for x in marks) else m
        if m == 1:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """The table with its column of pages replaced by ``text`` and n_chars (code points).

    A null or empty page, or one without main text, has an empty text. Rows are answered each, one by one; pages of
    any length are read whole. A column named text or n_chars besides is dropped for the result's.
    """
    arrow_rows(pages.sparkSession, 256)
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*(F.col(f"`{c}`") for c in rest)).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, page, 1 << 22):
            texts = [main_text(p) for p in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*(F.col(f"`{c}`") for c in (*rest, page))).mapInArrow(run, ", ".join(x for x in (kinds, "text string, n_chars long") if x))


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of the whole of pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op6_main_text": (op6_main_text, None)}
