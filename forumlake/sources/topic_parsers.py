"""Topic pages (HTML) of all space types to whole topics: state, space, tags, reactions, and posts with sub-posts.

A page is read into a small tree of elements. What the six space types and the page revisions share
(posts are elements `post_<n>` with an author, a floor, a moment and a text; badges close or silence a
topic; a script holds the reactions) is read in one way; where they differ, a `Recipe` per space type
names the places to look at, in the order in which they are tried, so that a page of any revision is
read by the first place it has. Pages of works, people and figures have no first post, so their
description is one, of a writer that no page has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.functions import scalars as S
from forumlake.schema import SPACE_TYPES, STATE
from forumlake.session import ship

_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("br hr img meta link input wbr area base col embed source".split())
_MOMENT = re.compile(r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}")
_FLOOR = re.compile(r"(?:#|floor-)(\d+)(?:-(\d+))?")
_ON_AIR = re.compile(r"首播:(.+)$")
_LIKES = re.compile(r"^[^\n]*?var data_likes_list = *(\{[^\n]*\});[^\n;]*$", re.M)
#: The writer of what no page says who wrote (a fixed value).
NOBODY = "_pseudo_writer"
BADGES = {"badgeStateSilent": STATE["SILENT"], "badgeStateClosed": STATE["CLOSED"], "badgeStateReopen": STATE["REOPEN"]}


@dataclass
class Node:
    """An element, by where its content lies in the page."""

    tag: str
    attrs: dict[str, str]
    start: int
    end: int = -1
    children: list[Node] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)  # stretches of its own text

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def below(self) -> Iterator[Node]:
        """All elements in it, in the order of the page."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def is_(self, step: str) -> bool:
        """Whether it fits one step: tag, #id or .class, or tag with either."""
        tag, mark, name = re.match(r"([a-z0-9]*)([#.]?)(.*)", step).groups()
        return (not tag or tag == self.tag) and (not mark or (name == self.attrs.get("id") if mark == "#" else name in self.classes))

    def all(self, path: str) -> Iterator[Node]:
        """Elements that fit a path of steps, each anywhere below the one before."""
        step, _, rest = path.partition(" ")
        for n in self.below():
            if n.is_(step):
                yield from n.all(rest) if rest else (n,)

    def first(self, *paths: str) -> Node | None:
        for p in paths:
            got = next(self.all(p), None)
            if got is not None:
                return got
        return None


class Tree:
    """A page's elements. Unclosed and misplaced tags are taken as browsers mostly take them."""

    def __init__(self, page: str):
        self.page = page
        self.root = Node("", {}, 0)
        stack, pos = [self.root], 0
        opened: dict[str, int] = {}  # how many of a tag are in the stack
        for m in _TOKEN.finditer(page):
            if m.start() > pos:
                stack[-1].texts.append((pos, m.start()))
            pos = m.end()
            if not m.group(3):
                continue
            tag = m.group(3).lower()
            if m.group(2):
                while opened.get(tag):  # closes what is open in it, too
                    last = stack.pop()
                    last.end = m.start()
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
                continue
            attrs = {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(m.group(4))}
            n = Node(tag, attrs, m.end(), m.end())
            stack[-1].children.append(n)
            if tag not in _VOID and not m.group(4).endswith("/"):
                n.end = len(page)
                stack.append(n)
                opened[tag] = opened.get(tag, 0) + 1
        if pos < len(page):
            stack[-1].texts.append((pos, len(page)))
        self.root.end = len(page)

    def text(self, n: Node | None, own: bool = False) -> str | None:
        """What an element shows; own: without its elements."""
        if n is None:
            return None
        parts = n.texts if own else sorted(p for x in (n, *n.below()) for p in x.texts)
        return " ".join(html.unescape(" ".join(self.page[a:b] for a, b in parts) if own else "".join(self.page[a:b] for a, b in parts)).split())

    def inner(self, n: Node | None) -> str | None:
        return None if n is None else self.page[n.start : n.end].strip()


def last_step(address: str) -> str:
    return address.rstrip("/").rpartition("/")[2]


def uid_of(style: str | None, username: str | None) -> int | None:
    """From an avatar's address, else from a name of digits."""
    name = last_step(style or "").partition(".")
    digits = re.match(r"\d+", name[0]) if name[1] else None
    if digits:
        return int(digits.group(0))
    return int(username) if username and username.isascii() and username.isdigit() and int(username) < 1 << 31 else None


@dataclass(frozen=True)
class Recipe:
    """Where pages of a space type have what they don't share; each a tuple of paths that are tried in turn."""

    space: tuple[str, ...] = ()  # the link to the space
    title: tuple[str, ...] = ()
    top: tuple[str, ...] = ()  # the first post
    described: tuple[str, ...] = ()  # or the description that takes its place
    id_from: tuple[str, ...] = ()  # a link that has the topic's id
    author: tuple[str, ...] = ()
    moment: tuple[str, ...] = ()
    redirected: tuple[str, ...] = ()
    club: tuple[str, ...] = ()


_FORUM = Recipe(space=("#pageHeader a.avatar", "h1 span a", "#pageHeader a"), title=("#pageHeader h1", "h1#pageHeader", "h1"), top=(".postTopic",))
_MONO = Recipe(space=("#headerSubject h1 a",), title=("#headerSubject h1 a",), described=("#columnCrtB .detail", ".detail"), id_from=("#headerSubject h1 a",))
RECIPES = {
    "group": _FORUM,
    "subject": _FORUM,
    "ep": Recipe(space=("#headerSubject h1 a",), title=("#columnEpA h2", "h2.title"), described=("#columnEpA .epDesc", ".epDesc"), id_from=("#columnEpA h2 small a",)),
    "blog": Recipe(
        title=("h1.title", "#pageHeader h1", "h1"), described=("#entry_content", ".blog_entry"), author=(".author .title a", "#pageHeader h1 a", ".author a"), moment=("div.time", ".re_info small", ".header small"),
        redirected=("#column_container h1",), club=("#wrapperClub .clubMain",),
    ),
    "person": _MONO,
    "character": _MONO,
}


class Page:
    """One page of a space type, read by its recipe."""

    def __init__(self, content: str, kind: str, topic: int):
        self.tree, self.kind, self.topic, self.recipe = Tree(content), kind, topic, RECIPES[kind]
        self.root = self.tree.root

    def _moment(self, text: str | None) -> str | None:
        m = _MOMENT.search(text or "")
        return m.group(0) if m else None

    def _post(self, n: Node, floor: int | None, related: int | None = None) -> dict | None:
        """A post element; None where it was folded or has no author."""
        t = self.tree
        number = n.attrs.get("id", "")[5:].strip()
        if not n.attrs.get("id", "").startswith("post_") or not number.isdigit():
            return None
        link = n.first("a.avatar")
        username = n.attrs.get("data-item-user") or (last_step(link.attrs.get("href", "")) if link else None)
        avatar = n.first("a.avatar span", "a.avatar img")
        name = n.first(".inner strong a", "strong a")
        sign = t.text(n.first(".inner span.tip_j", "span.tip_j"))
        badge = next((s for c, s in BADGES.items() if n.first("span." + c)), None)
        if not username:
            return None
        subs = n.first(".topic_sub_reply")
        if badge is None:
            body = n.first(".inner .message", ".inner .topic_content", ".inner .cmt_sub_content", ".message", ".topic_content", ".cmt_sub_content")
            info = t.text(n.first(".re_info", ".post_actions", "small"))
            place = _FLOOR.search(n.attrs.get("name", "")) or _FLOOR.search(info or "")
        else:
            body, info, place = n.first(".inner"), t.text(n.first("span.tip_j")), None
        return {
            "id": int(number), "floor": int(place.group(1)) if place else floor, "sub": int(place.group(2)) if place and place.group(2) else None, "related": related,
            "uid": uid_of(avatar and (avatar.attrs.get("style") or avatar.attrs.get("src")), username), "username": username, "nickname": t.text(name),
            "sign": sign[1:-1] if badge is None and sign and sign[0] == "(" and sign[-1] == ")" and len(sign) > 1 else None, "date": self._moment(info), "badge": badge, "html": t.inner(body),
            "subs": [p for c in subs.children if (p := self._post(c, None, int(number)))] if subs and related is None else [],
        }

    def _comments(self, first_floor: int) -> list[dict]:
        box = self.root.first("#comment_list")
        found = [self._post(c, k + first_floor) for k, c in enumerate(box.children)] if box else []
        return [q for p in found if p for q in (p, *p.pop("subs"))]

    def _status(self) -> str | None:
        if self.root.first("#colunmNotice p.text", ".notice p.text"):
            return "deleted"
        if self.recipe.club and self.root.first(*self.recipe.club):
            return "club"
        if self.recipe.redirected and not self.root.first(*self.recipe.described) and self.root.first(*self.recipe.redirected):
            return "redirect"
        return None

    def topic_row(self) -> dict:
        t, r, root = self.tree, self.recipe, self.root
        empty = {"status": "unparsed", "id": self.topic, "title": None, "display": None, "state": None, "date": None, "uid": None, "top": None, "space": None, "space_name": None, "tags": [], "related": [], "on_air": None, "posts": []}
        status = self._status()
        if status:
            return empty | {"status": status, "display": False, "state": {"deleted": STATE["DELETED"], "redirect": STATE["BLOG_REDIRECT"], "club": STATE["BLOG_CLUB"]}[status]}
        space, title = (root.first(*r.space) if r.space else None), root.first(*r.title)
        if title is None or r.space and space is None:
            return empty
        out = empty | {"status": "ok", "title": t.text(title, own=self.kind not in ("person", "character")), "display": True, "state": STATE["NORMAL"]}
        if space:
            out |= {"space": last_step(space.attrs.get("href", "")), "space_name": t.text(space)}
        if r.top:
            top = root.first(*r.top)
            first = self._post(top, 1) if top else None
            posts = ([first] if first else []) + self._comments(2)
            if first:
                first.pop("subs")
                out |= {"uid": first["uid"], "date": first["date"], "top": first["id"]}
            state = 0
            for p in posts:
                state |= p["badge"] or 0
            return out | {"posts": posts, "state": state, "display": state not in (STATE["SILENT"], STATE["CLOSED"])}
        link = root.first(*r.id_from) if r.id_from else None
        steps = [x for x in (link.attrs.get("href", "").split("/") if link else []) if x.isdigit()]
        out["id"] = own = int(steps[-1]) if steps else self.topic
        body = root.first(*r.described)
        pseudo = {"id": -own, "floor": 0, "sub": None, "related": None, "uid": 0, "username": NOBODY, "nickname": NOBODY, "sign": None, "date": None, "badge": None, "html": t.inner(body) or ""}
        if self.kind == "blog":
            who = root.first(*r.author)
            picture = root.first(".author img", "a.avatar span", "a.avatar img")
            username = last_step(who.attrs.get("href", "")) if who else None
            uid = uid_of(picture and (picture.attrs.get("src") or picture.attrs.get("style")), username)
            pseudo |= {"uid": uid, "username": username, "nickname": t.text(who), "date": self._moment(t.text(root.first(*r.moment)))}
            out |= {"uid": uid, "date": pseudo["date"], "tags": [x for n in root.all(".tags a") if (x := t.text(n))]}
            out["related"] = [int(x) for n in root.all(".entry-related-subjects a") if (x := last_step(n.attrs.get("href", ""))).isdigit()]
        else:
            aired = _ON_AIR.search(t.text(body.first("span.tip")) or "") if body and body.first("span.tip") else None
            out |= {"uid": 0, "on_air": aired.group(1).strip() if aired else None}
        return out | {"top": -own, "posts": [pseudo, *self._comments(1)]}


def parse_topic(content: str, kind: str, topic: int) -> dict:
    """The topic of a page, of one of the space types RECIPES; status tells what it was: ok, deleted, redirect, club or unparsed."""
    return Page(content, kind, topic).topic_row()


#: Parsers by space type; another one can be put in its place.
PARSERS: dict[str, Callable[[str, str, int], dict]] = dict.fromkeys(RECIPES, parse_topic)

_POST = "id: int, floor: int, sub: int, related: int, uid: int, username: string, nickname: string, sign: string, date: string, badge: int, html: string"
_SCHEMA = (
    "page_id bigint, type int, status string, id int, title string, display boolean, state int, date string, uid int, top int, space string, space_name string, "
    f"tags array<string>, related array<int>, on_air string, likes string, posts array<struct<{_POST}>>"
)
_FIELDS = ("id", "floor", "sub", "related", "uid", "username", "nickname", "sign", "date", "badge", "html")


def parse_topics(pages: DataFrame) -> DataFrame:
    """One topic per page: page_id, type, status, id, title, display, state, dateline, uid, top_post_pid, space, space_name, tags,
    related_subjects, likes (the script's JSON text) and posts, sub-posts after their post.

    pages: page_id bigint, type int, id int, contentHtml string. Null pages and unknown types give no
    row; a page on which nothing is found has the status `unparsed`.
    """
    ship(pages.sparkSession)
    names = {v: k for k, v in SPACE_TYPES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = pa.struct([(n, pa.string() if n in ("username", "nickname", "sign", "date", "html") else pa.int32()) for n in _FIELDS])
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(post)]
        keys = ("status", "id", "title", "display", "state", "date", "uid", "top", "space", "space_name", "tags", "related", "on_air")
        for b in batches:
            cols: list[list] = [[] for _ in types]
            for page, kind, topic, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = PARSERS[names[kind]](content, names[kind], topic)
                likes = _LIKES.search(content)
                row = [page, kind, *(t[k] for k in keys), likes.group(1) if likes else None, [{f: p[f] for f in _FIELDS} for p in t["posts"]]]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split(" ", 1)[0] for x in _SCHEMA.split(f", posts array<struct<{_POST}>>")[0].split(", ")] + ["posts"])

    known = pages.where(F.col("contentHtml").isNotNull() & F.col("type").isin(*names)).select("page_id", "type", "id", "contentHtml")
    raw = known.mapInArrow(run, _SCHEMA)
    aired = F.datediff(F.try_to_date("on_air", "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400
    ep = F.col("type") == SPACE_TYPES["ep"]
    mono = F.col("type").isin(SPACE_TYPES["person"], SPACE_TYPES["character"])

    def shape(p):
        pseudo = p["username"] == NOBODY
        state = F.coalesce(p["badge"], F.when(pseudo, F.lit(0)).otherwise(S.post_state(F.coalesce(p["html"], F.lit("")))))
        second = F.when(pseudo & ep, F.coalesce(aired, F.lit(0))).when(pseudo & mono, F.lit(0)).otherwise(S.post_second(p["date"]))
        return F.struct(*[p[f].alias(f) for f in _FIELDS if f not in ("date", "badge")], second.alias("dateline"), state.cast("int").alias("state"))

    return raw.select(
        "page_id", "type", "status", "id", "title", "display", "state", F.when(ep, aired).otherwise(S.post_second("date")).alias("dateline"), "uid", F.col("top").alias("top_post_pid"), "space", "space_name",
        "tags", F.col("related").alias("related_subjects"), "likes", F.transform("posts", shape).alias("posts"),
    )
