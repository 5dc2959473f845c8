"""Main text of web pages by two-pass block rules (operator 8)."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or our she so that the their them
    there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht
    noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous y
    al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus un una y ya""".split()
)
# Elements that begin a block; that hold no readable text; that hold none of the article.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
SILENT = frozenset("script style noscript template svg math title iframe object canvas audio video select textarea".split())
#: Silent elements whose content is not markup: only their own end tag ends them.
RAW = frozenset("script style noscript title iframe textarea".split())
#: What a page's head may hold; anything else ends it.
IN_HEAD = SILENT & frozenset("script style noscript template title".split()) | frozenset("base link meta basefont bgsound".split())
CORE, HEADINGS = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
OUTSIDE = frozenset("nav footer aside menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id that mark a container as no part of the article.
MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|(?:user|reader)?comments?(?:list|section|area|thread|form|box|wrap|wrapper|body)?|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?"
    r"|popup|promo\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Comments, CDATA, declarations, tags (a value quoted right behind its = may hold >), and a tag that the page breaks off in.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|</?[A-Za-z][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: In class names a capital behind a small letter begins a word.
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.20
LINKS_HIGH = 0.5
#: A marked container with so many times the text that is free of marks is the page's frame; so many times inside an article.
FRAME, INNER_FRAME = 10, 40


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool  # in a menu, footer ... or in a container marked so
    article: bool  # in an <article> or <main>
    heading: bool
    paragraph: bool
    marks: tuple[int, ...] = ()  # numbers of the open forms and containers whose class, id or role marks them; odd inside <article> or <main>


def silence(page: str, at: int, tag: str, ancestors: Counter, endless: set[str]) -> int:
    """Where a silent element that begins before `at` ends: behind its end tag, or before that of an element around it.

    `ancestors` counts the open elements by name; `endless` collects the raw elements
    without an end tag in the rest of the page.
    """

    def raw_end(name: str, at: int) -> int:
        end = None if name in endless else re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
        if not end:
            endless.add(name)
        return end.end() if end else -1

    if tag in RAW and (end := raw_end(tag, at)) >= 0:
        return end
    inside, open_inside = [], Counter()
    while m := _TOKEN.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if name == "body" and ancestors["head"]:
            return m.start()
        if m[1]:
            if open_inside[name]:
                while True:
                    last = inside.pop()
                    open_inside[last] -= 1
                    if last == name:
                        break
            elif name == tag:
                return at
            elif ancestors[name]:
                return m.start()
        elif name and name not in VOID and not m[3].endswith("/"):
            if name in RAW and (end := raw_end(name, at)) >= 0:
                at = end
            elif name not in RAW:
                inside.append(name)
                open_inside[name] += 1
    return len(page)


def blocks(page: str) -> Iterator[Block]:
    """Text blocks in page order; white space is collapsed, character references are decoded, silent elements skipped."""
    open_tags: list[tuple[str, bool, int]] = []  # name, whether it puts its content outside the article, number of its mark or 0
    marks: list[int] = []
    open_blocks: list[str] = []
    opened: Counter = Counter()
    parts: list[str] = []
    links = at = outside_depth = last_mark = 0
    endless: set[str] = set()

    def enter(tag: str, outside: bool, mark: bool) -> None:
        nonlocal outside_depth, last_mark
        if mark:
            last_mark = last_mark // 2 * 2 + 2 + any(opened[x] for x in CORE)
        open_tags.append((tag, outside, last_mark if mark else 0))
        if mark:
            marks.append(last_mark)
        opened[tag] += 1
        outside_depth += outside
        if tag in BLOCKS:
            open_blocks.append(tag)

    def leave() -> str:
        nonlocal outside_depth
        tag, outside, mark = open_tags.pop()
        if mark:
            marks.pop()
        opened[tag] -= 1
        outside_depth -= outside
        if tag in BLOCKS:
            open_blocks.pop()
        return tag

    def flush() -> Iterator[Block]:
        nonlocal links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            yield Block(text, links, outside_depth > 0, any(opened[x] for x in CORE), any(opened[x] for x in HEADINGS), open_blocks[-1:] == ["p"], tuple(marks))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            said = html.unescape(raw)
            parts.append(said)
            if opened["a"]:
                links += len(said.strip())

    while True:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            say(html.escape(m[0][9:-3]))
        if not tag:
            continue
        if open_tags and open_tags[-1][0] == "head" and not m[1] and tag not in IN_HEAD:
            yield from flush()
            leave()
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            if tag in BLOCKS:
                yield from flush()
            if opened[tag]:
                while leave() != tag:
                    pass
        elif tag in SILENT and not m[3].endswith("/"):
            if tag in BLOCKS:
                yield from flush()
            at = silence(page, at, tag, opened, endless)
        else:
            if tag in BLOCKS:
                yield from flush()
            if tag in ("p", "li") and open_tags and open_tags[-1][0] == tag:
                leave()
            if tag not in VOID and not m[3].endswith("/"):
                enter(tag, tag in OUTSIDE or (tag == "header" and not any(opened[x] for x in CORE)), tag == "form" or marked(tag, m[3]))
    yield from flush()


def marked(tag: str, attributes: str) -> bool:
    if tag in ("body", "head", "html") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and MARKS.search(_CASE.sub("-", value)):
            return True
    return False


def stop_share(block: Block) -> float:
    words = block.text.lower().split()
    return sum(map(STOP_WORDS.__contains__, words)) / len(words)


def judge_marks(found: list[Block]) -> None:
    """Put blocks of marked containers outside, but for a container that is a frame around the page's text, whatever its names say.

    From the outermost on, a mark counts unless its container holds FRAME times (inside
    an <article> or <main> INNER_FRAME times) the text that stands free of marks. Text is
    what has few links, that of <article> and <main> where there is some.
    """
    inside = [b for b in found if not b.outside]
    core = [b for b in inside if b.article] or inside
    prose = [b for b in core if b.link_chars <= LINKS_HIGH * len(b.text)]
    of: dict[int, list[int]] = {}
    for at, b in enumerate(prose):
        for k in b.marks:
            of.setdefault(k, []).append(at)
    marks_left = [len(b.marks) for b in prose]
    free = sum(len(b.text) for b, n in zip(prose, marks_left, strict=True) if not n)
    frames = set()
    for k in sorted(of):
        if sum(len(prose[at].text) for at in of[k]) > (INNER_FRAME if k % 2 else FRAME) * free:
            frames.add(k)
            for at in of[k]:
                marks_left[at] -= 1
                free += 0 if marks_left[at] else len(prose[at].text)
    for b in found:
        b.outside |= any(k not in frames for k in b.marks)


def first_pass(found: list[Block]) -> list[str]:
    """good, bad, near (probably good) or short for each block, from where it stands, its links, length and stop words.

    On a page without one block that has its share of stop words the language is none of
    the lists', so there length and link density decide alone.
    """
    long = [not b.outside and b.link_chars <= LINKS_HIGH * len(b.text) and len(b.text) >= LENGTH_LOW and not b.heading for b in found]
    shares = [stop_share(b) if is_long else 0.0 for b, is_long in zip(found, long, strict=True)]
    known = max(shares, default=0.0) >= STOP_LOW
    labels = []
    for b, is_long, share in zip(found, long, shares, strict=True):
        size = len(b.text)
        if b.outside:
            labels.append("bad")
        elif b.link_chars > LINKS_HIGH * size:
            labels.append("short" if b.article and (b.heading or b.paragraph or b.link_chars < 0.9 * size) else "bad")
        elif not is_long:
            labels.append("short")
        elif not known or share >= STOP_HIGH:
            labels.append("good" if size >= LENGTH_HIGH else "near")
        else:
            labels.append("near" if share >= STOP_LOW or b.article else "bad")
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is main text: short and near ones take the label of the nearest decided neighbours.

    Near blocks go only between two bad neighbours; short ones need a good neighbour on
    one side and are otherwise bad. Blocks inside the page's <article> or <main> have its
    borders as good neighbours; where a page has one, nothing else is main text.
    """
    inside = any(b.article and label != "bad" for b, label in zip(found, labels, strict=True))
    n = len(found)

    def nearest(step: int) -> list[str]:
        out, last = [""] * n, "bad"
        for k in range(n) if step > 0 else range(n - 1, -1, -1):
            before = found[k - step] if 0 <= k - step < n else None
            if found[k].article and not found[k].outside and (before is None or not before.article or before.outside):
                last = "good"
            elif not found[k].article and before is not None and before.article:
                last = "bad"
            out[k] = last
            if labels[k] in ("good", "bad") and not (labels[k] == "bad" and found[k].outside and found[k].article):
                last = labels[k]
            elif labels[k] == "near":
                last = "good"
        return out

    left, right = nearest(1), nearest(-1)
    keep = []
    for k, label in enumerate(labels):
        if label in ("near", "short"):
            label = "good" if "good" in (left[k], right[k]) or label == "near" and found[k].article else "bad"
        keep.append(label == "good" and (found[k].article or not inside))
    return keep


def main_text(page: str | None) -> str:
    found = list(blocks(page or ""))
    judge_marks(found)
    kept = second_pass(found, first_pass(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html, ...).

    Null, empty and textless html give ''. Html is read whole, however long; repeated
    rows are kept; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
