"""Labelled pages, from which the weights of the main body's scan are learned.

Two kinds: pages labelled by hand (HAND, written for this purpose), and pages of the corpus whose
markup labels them: one first-level heading in a block that also holds dated posts. Labels are used
for learning only; what comes out for a page is decided by the learned weights.
"""

from __future__ import annotations

import html
from collections import Counter
from dataclasses import dataclass, field

import regex

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z][^<>]*>", regex.S | regex.I)
_NAME = regex.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_CLASS = regex.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", regex.I)
_HIDDEN = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?=[\s>=/])|type\s*=\s*[\"']?hidden", regex.I)
_MOMENT = regex.compile(r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?\s*$")
#: Elements that enclose parts of a page; others are marks inside such parts.
BLOCKS = frozenset("html body div main article section aside nav header footer table tbody tr td th ul ol dl form fieldset".split())
VOID = frozenset("br hr img meta link input wbr col area base embed source".split())


@dataclass
class Element:
    name: str
    cls: str
    parent: int
    hidden: bool


@dataclass
class Line:
    text: str = ""  # what it shows, tags and entities resolved
    linked: int = 0  # characters of it inside links
    tags: list[str] = field(default_factory=list)
    at: int = 0  # the innermost block around its (first) text
    raw: str = ""
    links: list[str] = field(default_factory=list)

    @property
    def moment(self) -> bool:
        """Whether it ends in a day and a time, as the line above a post does."""
        return len(self.text) < 120 and _MOMENT.search(self.text) is not None


@dataclass
class Page:
    lines: list[Line]
    elements: list[Element]
    title: str

    def path(self, e: int) -> list[int]:
        """An element and those around it, from the inside out."""
        out = []
        while e >= 0:
            out.append(e)
            e = self.elements[e].parent
        return out


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def read_page(content: str) -> Page:
    """The lines (split at LF; a CR before it is blank) and the tree of blocks of a page."""
    raw = content.split("\n")
    lines = [Line(raw=r) for r in raw]
    elements = [Element("", "", -1, False)]
    stack: list[tuple[str, int]] = []  # open blocks and marks that hide: name, element
    no, link, head, titled = 0, 0, False, False
    title: list[str] = []
    placed = [False] * len(lines)

    def here() -> int:
        return stack[-1][1] if stack else 0

    def put(text: str) -> None:
        nonlocal no
        for i, piece in enumerate(text.split("\n")):
            no += i > 0
            if not piece.strip():
                if piece and lines[no].text:
                    lines[no].text += " "
                continue
            piece = html.unescape(piece)
            if titled:
                title.append(piece)
            if head or elements[here()].hidden:
                continue
            line = lines[no]
            if not placed[no]:
                placed[no], line.at = True, here()
            line.text += piece
            line.linked += len(piece.strip()) if link else 0

    pos = 0
    for m in _TOKEN.finditer(content):
        put(content[pos : m.start()])
        pos = m.end()
        tag = m.group(0)
        name = _NAME.match(tag)
        if tag.startswith("<!") or m.group(1) or not name:
            lines[no].tags.append("<hidden>" if m.group(1) or tag.startswith("<!--") else "<!>")
            no += tag.count("\n")
            continue
        n, closing = name.group(1).lower(), tag.startswith("</")
        lines[no].tags.append(f"</{n}>" if closing else f"<{n}>")
        if n == "a":
            link = 0 if closing else 1
            if not closing:
                lines[no].links.append(tag)
        if n == "head":
            head = not closing
        if n == "body":
            head = False
        if n == "title":
            titled = not closing
        if n in VOID:
            no += tag.count("\n")
            continue
        if not closing:
            hidden = elements[here()].hidden or _HIDDEN.search(tag) is not None
            if n in BLOCKS or hidden and not elements[here()].hidden:
                c = _CLASS.search(tag)
                elements.append(Element(n, c.group(1).strip() if c else "", here(), hidden))
                stack.append((n, len(elements) - 1))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == n:
                    del stack[k:]
                    break
        no += tag.count("\n")
    put(content[pos:])
    for x in lines:
        x.text = squeeze(x.text)
    return Page(lines, elements, squeeze("".join(title)))


OUTSIDE, TEXT, OTHER, SIGN = 0, 1, 2, 3

_BUTTON = regex.compile(r"^\s*<a\b[^>]*>[^<]{1,40}</a>\s*(?:<a\b[^>]*>[^<]{1,40}</a>\s*)*$", regex.I)
_BRACKETED = regex.compile(r"^\[[^\[\]]{1,16}\]$")
_RULED = regex.compile(r"^\s*<hr\b[^>]*>\s*<(?:i|em|small)\b", regex.I)
_SIGN = regex.compile(r"(?:^|[\s_-])sign(?:ature)?(?:$|[\s_-])|(?:^|\s)tip_j(?:$|\s)", regex.I)
_FLOOR = regex.compile(r"^#\d+(?:-\d+)?(?:\s*[-–·].{0,40})?$")


def _block(page: Page, heading: int, moments: list[int]) -> int:
    """The innermost block around the heading that holds a dated line below it, or -1."""
    around = [page.path(page.lines[m].at) for m in moments if m > heading]
    for e in page.path(page.lines[heading].at):
        if page.elements[e].name not in ("", "body", "html") and any(e in p for p in around):
            return e
    return -1


def body_span(page: Page) -> tuple[int, int, int] | None:
    """First and last line of the body, and its block, as the markup tells them; None where it doesn't."""
    moments = [i for i, x in enumerate(page.lines) if x.moment]
    firsts = [i for i, x in enumerate(page.lines) if "<h1>" in x.tags and x.text]
    if len(firsts) != 1 or not moments:
        return None
    block = _block(page, firsts[0], moments)
    if block < 0:
        return None
    inside = [i for i, x in enumerate(page.lines) if x.text and i >= firsts[0] and block in page.path(x.at)]
    return (firsts[0], inside[-1], block) if inside else None


def _is_sign(page: Page, line: Line, stop: int) -> bool:
    if _RULED.match(line.raw) or line.text.startswith("-- "):
        return True
    for e in page.path(line.at):
        if e == stop:
            return False
        if _SIGN.search(page.elements[e].cls):
            return True
    return False


def _not_post_text(line: Line) -> bool:
    """Author and date, floor number, button: lines inside a body that show no text of a post."""
    return (
        line.moment or _FLOOR.match(line.text) is not None or _BRACKETED.match(line.text) is not None
        or _BUTTON.match(line.raw) is not None or any('href="/user/' in a for a in line.links) and "<strong>" in line.tags
    )


def _posts(page: Page, heading: int, block: int, moments: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Of each post (an element right in the block that holds a dated line): the lines that may show its text, with their innermost block."""
    posts: dict[int, list[tuple[int, int]]] = {}
    for m in moments:
        path = page.path(page.lines[m].at)
        if block in path and path.index(block) > 0:
            posts[path[path.index(block) - 1]] = []
    for i, x in enumerate(page.lines):
        if i > heading and x.text and not _not_post_text(x) and not _is_sign(page, x, block):
            path = page.path(x.at)
            if block in path and path.index(block) > 0 and path[path.index(block) - 1] in posts:
                posts[path[path.index(block) - 1]].append((i, x.at))
    return posts


def _class_uses(page: Page, posts: dict[int, list[tuple[int, int]]]) -> Counter[tuple[str, str]]:
    """How often blocks of a class come in posts, after another text of the post, and before one."""
    out: Counter[tuple[str, str]] = Counter()
    for post, lines in posts.items():
        runs = [e for k, (_, e) in enumerate(lines) if k == 0 or lines[k - 1][1] != e or e == post]
        for k, e in enumerate(runs):
            c = page.elements[e].cls
            if e != post and c:
                out[c, "all"] += 1
                out[c, "after"] += k > 0
                out[c, "before"] += k < len(runs) - 1
    return out


def signature_classes(uses: Counter[tuple[str, str]]) -> dict[str, bool]:
    """Whether blocks of a class are signatures: never followed by text of the same post, mostly preceded by some."""
    return {c: uses[c, "before"] == 0 and 2 * uses[c, "after"] >= n for (c, kind), n in uses.items() if kind == "all"}


def labels_of(contents: list[str]) -> list[list[int] | None]:
    """For each page a label per line (OUTSIDE; TEXT; SIGN: a signature; OTHER: else inside, but no text of a post), or None where its markup tells none.

    A block's class is a signature's if, over all pages given, it is never followed by text of the
    same post and mostly preceded by some.
    """
    read = []
    uses: Counter[tuple[str, str]] = Counter()
    for content in contents:
        page = read_page(content)
        span = body_span(page)
        posts = _posts(page, span[0], span[2], [i for i, x in enumerate(page.lines) if x.moment]) if span else {}
        uses.update(_class_uses(page, posts))
        read.append((page, span, posts))
    signs = {c for c, yes in signature_classes(uses).items() if yes}
    out: list[list[int] | None] = []
    for page, span, posts in read:
        if span is None:
            out.append(None)
            continue
        y = [OTHER if span[0] <= i <= span[1] else OUTSIDE for i in range(len(page.lines))]
        y[span[0]] = TEXT
        for i in range(span[0] + 1, span[1] + 1):
            if page.lines[i].text and _is_sign(page, page.lines[i], span[2]):
                y[i] = SIGN
        for post, lines in posts.items():
            for i, e in lines:
                y[i] = TEXT if e == post or page.elements[e].cls not in signs else SIGN
        out.append(y)
    return out


def hand_labelled() -> list[tuple[str, str, list[int]]]:
    """(heading, content, labels) of the pages labelled by hand."""
    out = []
    for heading, marked in HAND:
        lines = marked.strip("\n").split("\n")
        out.append((heading, "\n".join(x[2:] for x in lines), ["-+.".index(x[0]) for x in lines]))
    return out


#: Pages labelled by hand: heading, and lines that begin with + (text of the main body), . (inside
#: it, but no text of a post) or - (outside).
HAND = (
    (
        "Best soup for a cold week",
        """
- <!DOCTYPE html>
- <html><head><title>Best soup for a cold week | Kettle</title></head>
- <body>
- <header><a href="/">Kettle</a> <a href="/news">News</a> <a href="/recipes">Recipes</a></header>
- <nav><ul>
- <li><a href="/a">Starters</a></li>
- <li><a href="/b">Soups</a></li>
- </ul></nav>
- <main>
+ <h1>Best soup for a cold week</h1>
. <p class="byline">By Ann Holt, 6 January 2024</p>
+ <p>We cooked nine soups in a week and asked the neighbours what they thought of each.</p>
+ <p>The lentil soup won, because it was warm, cheap and good on the second day as well.</p>
+ <blockquote>I would eat it every day if I could.</blockquote>
+ <ul>
+ <li>lentils</li>
+ <li>two onions</li>
+ </ul>
+ <p>Boil it slowly and don't forget the salt.</p>
- </main>
- <aside><h3>More stories</h3>
- <p>Nine ways to bake bread that… <a href="/r">Read more</a></p>
- <p>Advertisement: new pots at half price</p>
- </aside>
- <footer><p>© 2024 Kettle. All rights reserved.</p>
- <a href="/p">Privacy</a> <a href="/t">Terms of use</a></footer>
- </body></html>
""",
    ),
    (
        "Which edition should I buy?",
        """
- We use cookies to keep you signed in. Accept all
- Home | Groups | Blogs | Help
- Home > Reading room > Which edition should I buy?
- Popular groups
- Slow readers 214 members
- Map makers 88 members
- Related topics
- The old edition had better paper and I still… Read more
- A long answer about bindings (12)
- Sponsored: bookcases this week only
- Last updated 2024-2-3 10:01
-
+ Which edition should I buy?
. Dora posted by 2024-2-1 09:00
+ I found two editions in the shop and can't decide which one I want.
+ - the red one
+ - the blue one
. [Reply]
. Emil posted by 2024-2-1 09:30
+ > I found two editions in the shop
+ Take the blue one, the print is larger.
+
+ It also has the maps.
. -- Books are my weather.
. [Reply] [Report]
. Fay posted by 2024-2-2 18:10
+ > It also has the maps
+ Agreed.
+ print(sorted(editions))
. -- See you there.
- Page 1 of 2 · Next
- Report  Share this page
- Privacy · Terms of use · Contact
- © 2024 Reading room archive. All texts belong to their writers.
""",
    ),
    (
        "Minutes of the river walk",
        """
- Start | Lists | Search
- Lists > Walks > Minutes of the river walk
+ Minutes of the river walk
. Gil posted by 2024-3-1 19:20
+ > the first part of the path
+ > a map of the bridges and some notes
+ Both are in the box by the door.
. -- Gil
. [Reply]
. Hew posted by 2024-3-1 20:05
+ > both are in the box
+ > text of the older minutes
+ > who
+ Thanks, found them
. -- my boots are wet
. [Reply]
. Ida posted by 2024-3-2 08:00
+ > another walk
+ Count me in
- Page 1 of 1
- Lists | Next list
- Contact · Terms of use
- © 2024 Walks archive
""",
    ),
    (
        "这家面馆还开着吗",
        """
- 本站使用浏览器记录，继续访问即表示同意。
- 首页 | 小组 | 日志 | 帮助
- 登录后可以参与讨论
- 相关话题
- 《旧城早点》 (12)
- 上周末去吃了一次，汤底比以前淡，但是…
- 热门小组
- 城南散步 214 位成员
- 推广：周末特卖，本周包邮
- 最后更新 2024-2-3 10:01
+ 这家面馆还开着吗
. 阿冬 发表于 2024-2-1 09:00
+ 上个月路过的时候看见门口贴了一张纸，没有看清写的是什么。
+ 有人最近去过吗？
. [回复]
. 小满 发表于 2024-2-1 12:11
+ > 有人最近去过吗？
+ 还开着，只是换了老板。
+ 《城南面谱》
+ 谢谢楼主！
. -- 等一个后续。
. [回复]
- 第 1 页 / 共 2 页 下一页
- 举报  分享到动态
- 隐私说明 · 使用条款 · 联系我们
- © 2024 城南 存档站 文字归作者所有
""",
    ),
    (
        "Wer kennt diese Melodie?",
        """
- Diese Seite speichert Einstellungen auf Ihrem Gerät. Einverstanden
- Start | Gruppen | Blogs | Hilfe
- Ähnliche Themen
- Das Lied am Ende war schön, aber… Weiterlesen
- Anzeige: Noten im Angebot
+ Wer kennt diese Melodie?
. Gerd schrieb am 2024-2-1 09:00
+ Ich habe sie gestern im Zug gehört und weiß nicht, wie das Stück heißt.
. [Antworten]
. Hanna schrieb am 2024-2-1 10:00
+ > wie das Stück heißt
+ Das ist aus der dritten Folge.
+ Danke!
. -- Sehe ich auch so.
- Seite 1 von 2 · Weiter
- Melden  Teilen
- Datenschutz · Nutzungsbedingungen
- © 2024 Klang Archiv. Alle Texte gehören ihren Verfassern.
""",
    ),
    (
        "この駅の名前を知っていますか",
        """
- 当サイトは閲覧の記録を保存します。同意する
- ホーム | グループ | ブログ | ヘルプ
- 関連する話題
- 昨日の夜に乗った電車の中で見た… 続きを読む
- 広告：今週のみ送料無料
+ この駅の名前を知っていますか
. イナ 投稿 2024-2-1 09:00
+ 写真だけが残っていて、どこで撮ったのか思い出せません。
. [返信]
. ケン 投稿 2024-2-1 10:00
+ 北の方の線だと思います。
+ ありがとう！
. -- また明日。
- 1 / 2 ページ 次へ
- 通報  共有
- 個人情報 · 利用規約
- © 2024 駅の記録 文章は書いた人のものです
""",
    ),
    (
        "Lost glove",
        """
- <html><body>
- <div class="menu"><a href="/">Home</a> <a href="/g">Groups</a></div>
- <p>This topic has been removed.</p>
- <p>Log in to take part in the discussion.</p>
- <h3>Related topics</h3>
- <li><a href="/1">Found glove</a> (3)</li>
- <p>I saw one near the bridge and… <a href="/2">Read more</a></p>
- <div class="footer">© 2024 Park archive</div>
- </body></html>
""",
    ),
)
