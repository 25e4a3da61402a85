"""Topic pages (HTML) to topic documents: heading, posts, authors, floors, dates and states.

Posts are found by what all page revisions share: elements with an id ``post_<n>``, inside
them a link to the author, a floor number, a date on the forum's clock and an element with
the text. What differs between revisions is a table of class names, tried from the page's own
revision down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.functions import scalars as S

#: Classes of elements that hold a post's text, by first style revision; newest first.
TEXT_CLASSES = {430: ("topic_content", "message", "cmt_sub_content"), 398: ("topic_content", "message", "reply_content", "inner", "blog_entry")}
_VOID = frozenset("br hr img meta link input wbr area base col embed source".split())
_DATE = re.compile(r"(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2})")
_FLOOR = re.compile(r"#(\d+)(?:-(\d+))?")
_POST_ID = re.compile(r"^post_(\d+)$")
_USER = re.compile(r"/user/([^/?#\"]+)")


class _Posts(HTMLParser):
    """Collects (post id, username, nickname, floor, sub floor, date, html of the text)."""

    def __init__(self, classes: tuple[str, ...]):
        super().__init__(convert_charrefs=False)
        self.classes = classes
        self.open: list[tuple[str, str]] = []  # tag, role
        self.posts: list[dict] = []
        self.heading, self.depth_text = "", 0
        self.current: list[int] = []
        self.parts: list[str] | None = None
        self.in_user = False

    def _post(self) -> dict | None:
        return self.posts[self.current[-1]] if self.current else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        role = ""
        m = _POST_ID.match(a.get("id", ""))
        if m:
            self.posts.append({"id": int(m.group(1)), "username": None, "nickname": None, "floor": None, "sub": None, "date": None, "html": None, "outer": self.current[-1] if self.current else None})
            self.current.append(len(self.posts) - 1)
            role = "post"
        p = self._post()
        if self.parts is not None:
            self.parts.append(self.get_starttag_text() or "")
        elif p is not None and p["html"] is None and set(a.get("class", "").split()) & set(self.classes):
            self.parts, role = [], role or "text"
        elif p is not None and tag == "a" and p["username"] is None and (u := _USER.search(a.get("href", ""))):
            p["username"], self.in_user, role = u.group(1), True, "user"
        elif tag == "h1":
            role = "heading"
        if tag not in _VOID:
            self.open.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, role = self.open.pop()
            if role == "text" and self.parts is not None:
                p = self._post()
                if p is not None:
                    p["html"] = "".join(self.parts).strip()
                self.parts = None
            elif role == "post":
                self.current.pop()
            elif role == "user":
                self.in_user = False
            if t == tag:
                break
        if self.parts is not None:
            self.parts.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        p = self._post()
        if self.parts is not None:
            self.parts.append(data)
        elif any(r == "heading" for _, r in self.open):
            self.heading += data
        elif p is not None:
            if self.in_user:
                p["nickname"] = (p["nickname"] or "") + data
            if p["floor"] is None and (m := _FLOOR.search(data)):
                p["floor"], p["sub"] = int(m.group(1)), int(m.group(2)) if m.group(2) else None
            if p["date"] is None and (m := _DATE.search(data)):
                p["date"] = m.group(1)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def parse_posts(html: str, revision: int = 398) -> tuple[str, list[dict]]:
    """(heading, posts) by the classes of the page's revision, else of the others, newest first; the first that finds a text counts."""
    own = max((r for r in TEXT_CLASSES if r <= revision), default=min(TEXT_CLASSES))
    best: tuple[str, list[dict]] = ("", [])
    for r in [own, *sorted((r for r in TEXT_CLASSES if r != own), reverse=True)]:
        x = _Posts(TEXT_CLASSES[r])
        x.feed(html)
        x.close()
        if any(p["html"] is not None for p in x.posts):
            return x.heading.strip(), x.posts
        best = best if best[1] else (x.heading.strip(), x.posts)
    return best


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, heading and a post in each row, of pages (page_id, contentHtml); pages without posts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "heading", "id", "username", "nickname", "floor", "sub", "date", "html")}
            for page, html, rev in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                heading, posts = parse_posts(html, rev)
                for p in posts:
                    out["page_id"].append(page)
                    out["heading"].append(heading)
                    for k in ("id", "username", "nickname", "floor", "sub", "date", "html"):
                        out[k].append(p[k])
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    schema = "page_id bigint, heading string, id bigint, username string, nickname string, floor int, sub int, date string, html string"
    raw = pages.where("contentHtml is not null").select("page_id", "contentHtml", S.style_revision("contentHtml")).mapInArrow(run, schema)
    return raw.select("page_id", "heading", "id", "username", "nickname", "floor", "sub", S.post_second("date").alias("dateline"), S.post_state(F.col("html")).alias("state"), "html")
