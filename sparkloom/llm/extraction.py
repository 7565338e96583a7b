"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
UNSEEN = frozenset("head script style noscript template iframe svg map select textarea button annotation annotation-xml".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav footer aside form menu dialog".split())
#: Elements with raw content, which goes on up to their own end.
RAW = frozenset("script style textarea noscript template iframe svg".split())
#: Elements that the next of their kind ends.
_IMPLIED = frozenset("p li option tr td th dt dd".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a block; any other element ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Words in a class, id or role that name such surroundings.
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that name reader comments; what is named so is left out whatever it holds but main.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Those of the words that no wrapper of an article has.
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner consent cookie cookies gdpr newsletter popup promo promoted sponsor sponsored".split())
#: Parts that go with such a word in one name, before it or behind it. Other compounds name a subject.
COMPANIONS = frozenset(
    "area aria articles bar block body bottom box button buttons center class column container content count entry feed form global group head header holder icon icons inner item items label left link links list listing local main message module outer page panel placeholder pod post posts primary reading region right row section secondary site slot stories strip tab thread title top unit user widget widgets wrap wrapper zone".split()
)
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can do for from had has have he her his how i if in into is it its more no not of on one or our out she so some that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bis das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses son sur un une vous "
    "al como con de del el ella en entre es esta este la las le lo los más me mi muy no o para pero por que se si sin sobre su sus también un una y ya".split()
)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^>\"'<]*+)(>?)")
_STOP, _GREATER, _LESS = re.compile("[>\"']"), re.compile(">"), re.compile("<")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HINT = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass."""

    max_link_density: float = 0.5
    short_chars: int = 70
    long_chars: int = 200
    few_stop_words: float = 0.05
    many_stop_words: float = 0.18


@dataclass
class Block:
    text: str
    link_density: float
    stop_density: float
    in_article: bool
    named: int = -1  # the outermost element around it that only its name tells to be surroundings
    kind: str = field(default="")


def _named(attributes: str, words: frozenset) -> bool:
    """Whether a class, id or role is one of the words, or a compound of one with its usual companions, or with numbers."""
    for m in _NAMES.finditer(attributes):
        for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower().split():
            parts = [x for x in re.split(r"[_\-:]+", token) if x]
            own = sum(x in words for x in parts)
            if own and (parts[0] in words or parts[-1] in words) and all(x in words or x in COMPANIONS or x in AROUND_WORDS or x.isdigit() for x in parts):
                return True
    return False


def _surrounds(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is left out: tag (its kind, or it is hidden), comment or name (of a class, id or role); else ""."""
    if tag in UNSEEN or tag in AROUND or tag == "header" and not in_article:
        return "tag"
    if not attributes or tag in ("body", "html", "main"):
        return ""
    if _HINT.search(attributes) and _hidden(attributes):
        return "" if tag == "article" else "tag"
    if _named(attributes, COMMENT_WORDS):
        return "comment"
    if tag == "article" or not _named(attributes, AROUND_WORDS):
        return ""
    return "tag" if _named(attributes, NEVER_WORDS) else "name"


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes hide it: hidden, aria-hidden="true" or a style with display: none."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            return True
    return False


class _Tags:
    """The tags of a page in order. What a search has passed over is remembered, so broken pages take linear time too."""

    def __init__(self, page: str):
        self.page, self.passed = page, {}
        self.unclosed: set[int] = set()  # quotes from which no tag ends
        self.endless: set[str] = set()  # raw elements without a further end

    def _next(self, what: re.Pattern, at: int) -> int:
        """Where `what` comes next, or the page's length."""
        begin, found = self.passed.get(what, (1, 0))
        if not begin <= at <= found:
            m = what.search(self.page, at)
            begin, found = at, m.start() if m else len(self.page)
            self.passed[what] = begin, found
        return found

    def _end(self, at: int) -> int:
        """The end of a tag whose attributes begin at `at`: past quoted values, or the first > if a quote isn't closed."""
        page, here, trail = self.page, at, []
        while (stop := self._next(_STOP, here)) < len(page):
            if page[stop] == ">":
                return stop + 1
            trail.append(stop)
            close = -1 if stop in self.unclosed else page.find(page[stop], stop + 1)
            if close < 0:
                break
            here = close + 1
        self.unclosed.update(trail)
        return self._next(_GREATER, at) + 1

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next tag from `at` on: start, end, name ("" of a comment or declaration), whether it closes, attributes."""
        page = self.page
        while (start := self._next(_LESS, at)) < len(page):
            if m := _NAME.match(page, start):
                if m[4]:
                    return start, m.end(), m[2].lower(), m[1] == "/", m[3]
                if (end := self._end(m.end(2))) <= len(page):
                    return start, end, m[2].lower(), m[1] == "/", page[m.end(2) : end - 1]
            elif page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(page), "", False, ""
            elif page.startswith(("<!", "<?"), start) and (end := self._next(_GREATER, start) + 1) <= len(page):
                return start, end, "", False, ""
            at = start + 1
        return None

    def after_raw(self, tag: str, at: int) -> int:
        """The end of a raw element whose content begins at `at`; without one, that of the page for scripts and styles."""
        if tag not in self.endless:
            if close := re.compile(rf"</{tag}\s*>", re.I).search(self.page, at):
                return close.end()
            self.endless.add(tag)
        return len(self.page) if tag in ("script", "style") else at


def _holders(page: str) -> dict[int, str]:
    """Where elements begin that hold an article or main, with what they hold: main, if both."""
    found: dict[int, str] = {}
    stack: list[tuple[str, int]] = []
    tags, opened, at = _Tags(page), Counter(), 0
    while m := tags.after(at):
        start, at, tag, closing, attributes = m
        if not tag or tag in VOID or not closing and attributes.endswith("/"):
            continue
        if not closing:
            if tag in RAW:
                at = tags.after_raw(tag, at)
                continue
            if tag in _IMPLIED and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
            if tag == "main" or tag == "article" and not _named(attributes, COMMENT_WORDS):
                for _, k in reversed(stack):
                    if found.get(k) in (tag, "main"):
                        break
                    found[k] = tag
            if tag not in INLINE:
                stack.append((tag, start))
                opened[tag] += 1
        elif opened[tag]:
            while (was := stack.pop()[0]) != tag:
                opened[was] -= 1
            opened[tag] -= 1
    return found


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order, without what stands in elements that surround an article.

    Blocks in elements that only their name tells to be such are marked with the outermost one."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it is left out, whether it is an article
    parts: list[tuple[str, bool]] = []
    left_out = articles = links = 0
    named, depth = -1, -1  # the outermost element left out by name, and its place on the stack
    holders: dict[int, str] | None = None

    def end() -> None:
        text = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
        if text:
            linked = len(" ".join(entities.unescape("".join(x for x, a in parts if a)).split()))
            words = _WORD.findall(text.lower())
            stops = sum(w in STOP_WORDS for w in words)
            found.append(Block(text, linked / len(text), stops / len(words) if words else 0.0, articles > 0, named))
        parts.clear()

    tags, opened, at = _Tags(page), Counter(), 0
    while at < len(page):
        m = tags.after(at)
        upto = m[0] if m else len(page)
        if upto > at and not left_out:
            parts.append((page[at:upto], links > 0))
        if not m:
            break
        start, at, tag, closing, attributes = m
        if not tag:
            continue
        if tag == "br":
            if parts and parts[-1][0] == "\n" and not left_out:
                end()  # two line breaks end a block
            elif not left_out:
                parts.append(("\n", False))
            continue
        if tag not in INLINE and not left_out:
            end()
        if tag in VOID:
            continue
        if not closing:
            if tag in RAW:
                at = tags.after_raw(tag, at)
                continue
            if attributes.endswith("/"):
                continue
            if tag in _IMPLIED and stack and stack[-1][0] == tag:
                stack_left, stack_article = stack[-1][1:]
                opened[stack.pop()[0]] -= 1
                left_out -= stack_left
                articles -= stack_article
                if len(stack) <= depth:
                    named, depth = -1, -1
            why = _surrounds(tag, attributes, articles > 0)
            out, article = why != "", tag == "main" or tag == "article" and why != "comment"
            if out and not left_out and tag not in UNSEEN:  # an article in an aside, or among comments, is not the page's
                holders = _holders(page) if holders is None else holders
                out = holders.get(start) not in (("main",) if tag in ("nav", "aside", "footer", "menu") or why == "comment" else ("main", "article"))
            if out and why == "name":
                out = False  # its blocks are marked
                if named < 0:
                    named, depth = start, len(stack)
            stack.append((tag, out, article))
            opened[tag] += 1
            left_out += out
            articles += article
            links += tag == "a"
        elif opened[tag]:
            while stack:
                was, out, article = stack.pop()
                opened[was] -= 1
                left_out -= out
                articles -= article
                links -= was == "a"
                if len(stack) <= depth:
                    named, depth = -1, -1
                if was == tag:
                    break
    if not left_out:
        end()
    return found


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """The blocks that are main text.

    First pass, by the block alone: many links: bad. Inside an article a long block, or one with some stop words, is
    good; elsewhere it needs many stop words. The rest, mostly short, is undecided. Second pass: an undecided block takes
    the label of the nearest decided block; between a good and a bad one as near it is good inside an article only.

    Blocks of elements that only their name tells to be surroundings go, but for an element that holds three quarters of
    the text that the first pass finds good, on a page without an article elsewhere: its name tells a subject, or the whole page. Where articles hold most of that text, only
    their blocks count. Where there is none, length and link density decide: blocks with few links that are long enough or
    in an article are good, or else all with few links.
    """
    for b in found:
        long, some = len(b.text) >= rules.long_chars, b.stop_density >= rules.few_stop_words
        if b.link_density > rules.max_link_density:
            b.kind = "bad"
        elif b.in_article and (long or some and len(b.text) >= rules.short_chars):
            b.kind = "good"
        elif not b.in_article and len(b.text) >= rules.short_chars and b.stop_density >= rules.many_stop_words:
            b.kind = "good"
        elif not b.in_article and long and not some:
            b.kind = "bad"
    good = Counter()
    for b in found:
        good[b.named] += len(b.text) * (b.kind == "good")
    most = max(good, key=lambda k: (good[k], -k), default=-1)
    wraps = 4 * good[most] > 3 * sum(good.values()) and not any(b.in_article and b.named != most for b in found)
    found = [b for b in found if b.named < 0 or wraps and b.named == most]
    if not any(b.kind == "good" for b in found):
        few = [b for b in found if b.link_density <= rules.max_link_density]
        for b in [b for b in few if b.in_article or len(b.text) >= rules.short_chars] or few:
            b.kind = "good"
    inside = sum(len(b.text) for b in found if b.in_article and b.kind == "good")
    if inside * 2 > sum(len(b.text) for b in found if b.kind == "good"):
        found = [b for b in found if b.in_article]
    decided = [(i, b.kind) for i, b in enumerate(found) if b.kind]
    before, k = None, 0
    for i, b in enumerate(found):
        while k < len(decided) and decided[k][0] <= i:
            before, k = decided[k], k + 1
        if not b.kind:
            after = decided[k] if k < len(decided) else None
            near = sorted((abs(x[0] - i), (x[1] == "bad") == b.in_article, x[1]) for x in (before, after) if x)
            b.kind = "~" + (near[0][2] if near else "good" if b.in_article else "bad")
    return [b for b in found if b.kind.endswith("good")]


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The main text's blocks joined by two line ends; null or empty pages give the empty text."""
    return "\n\n".join(b.text for b in classify(blocks(page or ""), rules))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), rules: Rules = Rules()) -> DataFrame:
    """Columns `keep` of every page, and text and n_chars (code points) of its main text.

    A row at a time, so no shuffle and no group. Null or empty html, and pages without main text, give text "". Repeated
    rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), rules) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, f"{fields}, text string, n_chars long")
