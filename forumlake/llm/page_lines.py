"""A page cut into lines, and each line into the tokens that are scored.

Only lines, tags and words are looked at, by a few patterns per line; no tree is built. Nothing
is assumed about a page's correctness: tags may be unclosed, in either case, or missing altogether.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_HEAD = re.compile(r"<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I)
_BROKEN_TAG = re.compile(r"<[/!a-zA-Z][^<>]*\n[^<>]*>")
_HIDDEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)\b(?=[^<>]*(?:display\s*:\s*none|visibility\s*:\s*hidden|\shidden[\s>=/]))[^<>]*>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<![^<>]*>")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^">]*)|'([^'>]*)|([^\s"'>]+))""", re.I)
_LINK = re.compile(r"<a\b[^>]*>(.*?)(?:</a|\Z)", re.I)
_WORD = re.compile("[㐀-䶿一-鿿]{1,2}|[぀-ヿ]+|[^\\W\\d_㐀-鿿぀-ヿ]+|\\d+|©")
_MOMENT = re.compile(r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?$")
_ENDS = frozenset(".!?。！？…~)）」』\"”")
_BRACKETED = re.compile(r"^\[[^\[\]]{1,16}\]$")
_FLOOR = re.compile(r"^#\d+")
_BARS = (" | ", " · ", " » ", " › ", " > ")
_COUNTED = re.compile(r"\(\d+\)$")
#: Elements that enclose parts of a page and are closed again; their class is a line's surroundings.
BLOCKS = frozenset("div main article section aside nav header footer table td tr ul ol dl form fieldset blockquote".split())
#: Tokens that tell tags; a text without tags has none of them but "i:" and "h:0".
MARKUP = ("t:", "q:", "c:", "i:", "h:", "f:linked")


@dataclass(slots=True, eq=False)
class Fact:
    """What a line tells by itself, wherever it stands."""

    text: str  # what it shows
    tokens: frozenset[str]
    blocks: tuple[tuple[str, str], ...]  # its tags of blocks: name (or /name), class or name
    level: str  # the last heading tag in it
    moment: bool  # whether it ends in a day and a time, as the line above a post does


@dataclass
class Lines:
    facts: list[Fact]
    around: list[tuple[str, ...]]  # of each line, the tokens of where it stands
    anchors: list[bool]  # whether a line is the topic's heading or a dated line
    heading: int  # the line with the topic's heading, or -1

    def tokens(self, i: int) -> frozenset[str]:
        return self.facts[i].tokens.union(self.around[i])


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def _blank(m: re.Match) -> str:
    return "\n" * m.group(0).count("\n")


def _joined(m: re.Match) -> str:
    """A tag broken over lines, in one piece; the line ends come after it."""
    t = m.group(0)
    return t.replace("\n", " ") + "\n" * t.count("\n")


def _ends(content: str, name: str) -> dict[int, int]:
    """Where each closed element of a name ends, by the place after its opening tag; one pass, however they are nested."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for t in re.compile(rf"<(/?){name}\b[^<>]*>", re.I).finditer(content):
        if not t.group(1):
            opened.append(t.end())
        elif opened:
            out[opened.pop()] = t.end()
    return out


def _without_hidden(content: str) -> str:
    """Elements that aren't shown are blanked, up to their closing tag (or the next tag, if there is none)."""
    out, at = [], 0
    ends: dict[str, dict[int, int]] = {}
    for m in _HIDDEN.finditer(content):
        if m.start() < at:
            continue
        name = m.group(1).lower()
        if name not in ends:
            ends[name] = _ends(content, name)
        end = ends[name].get(m.end(), -1)
        if end < 0:
            nxt = content.find("<", m.end())
            end = nxt if nxt >= 0 else len(content)
        out += [content[at : m.start()], "\n" * content.count("\n", m.start(), end)]
        at = end
    return "".join([*out, content[at:]])


def visible_lines(content: str) -> tuple[list[str], str]:
    """The lines of a page without comments, scripts, head and hidden parts, and the head's title. Line numbers stay."""
    shown, title = content, ""
    if "<" in content:
        if "<!--" in shown or "</" in shown:
            shown = _DROP.sub(_blank, shown)
        m = _TITLE.search(shown)
        if m:
            title = squeeze(html.unescape(m.group(1)))
            shown = _HEAD.sub(_blank, shown, count=1)
            shown = _TITLE.sub(_blank, shown)
        shown = _BROKEN_TAG.sub(_joined, shown)
        if _HIDDEN.search(shown):
            shown = _without_hidden(shown)
    return shown.split("\n"), title


def line_fact(line: str) -> Fact:
    """Text and tokens of one line: t: tags, q: its tags in order, c: their classes; w: words, b: pairs of
    words of short lines, s: the first word; f: forms, l: length."""
    tok: set[str] = set()
    blocks: list[tuple[str, str]] = []
    level = ""
    if "<" in line:
        names = []
        for slash, name, attrs in _TAG.findall(line):
            n = name.lower()
            names.append(slash + n)
            c = ""
            if attrs and not slash and "lass" in attrs.lower():
                m = _CLASS.search(attrs)
                c = (m.group(1) or m.group(2) or m.group(3) or "").strip() if m else ""
                tok.update("c:" + x for x in c.split())
            if n in BLOCKS:
                blocks.append((slash + n, c or n))
            elif len(n) == 2 and n[0] == "h" and n[1].isdigit() and not slash:
                level = n[1]
        tok.update("t:" + n for n in names)
        tok.add("q:" + ",".join(names[:4]))
        linked = sum(map(len, _LINK.findall(line))) if "a" in names else 0
        text = squeeze(html.unescape(_TAG.sub("", line)))
        if linked * 2 > len(text):
            tok.add("f:linked")
    else:
        text = squeeze(html.unescape(line) if "&" in line else line)
    if not text:
        tok.add("l:0")
        return Fact(text, frozenset(tok), tuple(blocks), level, False)
    words = [w if w[0] > "9" else "0" for w in _WORD.findall(text.lower())]
    tok.update(["w:" + w for w in set(words)])
    tok.add(f"l:{len(text).bit_length()}")
    if words:
        tok.add("s:" + words[0])
    if len(words) <= 10:
        tok.update([f"b:{x} {y}" for x, y in zip(words, words[1:], strict=False)])
    moment = text[-1].isdigit() and len(text) < 120 and _MOMENT.search(text) is not None
    if moment:
        tok.add("f:moment")
    if text[-1] in _ENDS:
        tok.add("f:ended")
    if text[0] in "[#-*>":
        if text[0] == ">":
            tok.add("f:quoted")
        if _BRACKETED.match(text):
            tok.add("f:bracketed")
        if text.startswith("-- "):
            tok.add("f:dashes")
        elif text[0] in "-*":
            tok.add("f:item")
        if _FLOOR.match(text):
            tok.add("f:floor")
    if any(b in text for b in _BARS):
        tok.add("f:bars")
    if text[-1] == ")" and _COUNTED.search(text):
        tok.add("f:counted")
    return Fact(text, frozenset(tok), tuple(blocks), level, moment)


class Reader:
    """Reads pages, and remembers the facts of short lines, as menus and tags come again and again."""

    SHORT, MOST = 160, 50_000

    def __init__(self) -> None:
        self.known: dict[str, Fact] = {}

    def fact(self, line: str) -> Fact:
        got = self.known.get(line)
        if got is None:
            got = line_fact(line)
            if len(line) <= self.SHORT and len(self.known) < self.MOST:
                self.known[line] = got
        return got

    def read(self, content: str, title: str | None) -> Lines:
        """A page's lines, and of each the tokens of where it stands: i: the class around it, h: the last
        heading tag so far, a: before or after the topic's heading, m: after a dated line since then, u: right below one."""
        raw, own = visible_lines(content)
        heading = squeeze(title) or own.rpartition(" | ")[0] or own
        facts = [self.fact(line.strip()) for line in raw]
        at = _heading_line(facts, heading)
        around: list[tuple[str, ...]] = []
        stack: list[tuple[str, str]] = []
        opened: dict[str, int] = {}  # how many of a name are in the stack
        block, level, dated, above = "i:", "h:0", "m:0", "u:0"
        for i, f in enumerate(facts):
            inner = block
            if f.blocks:
                for n, c in f.blocks:
                    if n[0] != "/":
                        stack.append((n, c))
                        opened[n] = opened.get(n, 0) + 1
                        inner = "i:" + c
                        continue
                    while opened.get(n[1:]):  # closes what is open in it, too
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == n[1:]:
                            break
                block = "i:" + stack[-1][1] if stack else "i:"
            if f.level:
                level = "h:" + f.level
            if i > at and f.moment:
                dated = "m:1"
            around.append((inner, level, "a:?" if at < 0 else "a:1" if i > at else "a:0" if i < at else "f:title", dated, above))
            above = "u:1" if f.moment else "u:0"
        return Lines(facts, around, [f.moment or i == at for i, f in enumerate(facts)], at)


def _heading_line(facts: list[Fact], heading: str) -> int:
    """The line that shows the topic's heading: in a first-level tag, else the last such line before the first post; -1 without one."""
    same = [i for i, f in enumerate(facts) if f.text == heading] if heading else []
    first = [i for i in same or range(len(facts)) if facts[i].level == "1" and facts[i].text]
    if first or not same:
        return first[0] if first else -1
    post = next((i for i in range(same[0], len(facts)) if facts[i].moment), len(facts))
    return [i for i in same if i < post][-1]
