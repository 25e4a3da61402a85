"""The forum's scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlake.schema import STATE

# The two radices, the modulus and the masks of the string hash.
HASH_RADIX_LOW, HASH_RADIX_HIGH, HASH_MOD = 17, 19_260_817, 1_000_000_007
MASK_LOW, MASK_HIGH = 0x7FFF, 0x7FFF8000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_hash(s: Column | str) -> Column:
    """A stable id of a name: itself if it is written as an int, else a negative hash of its UTF-16 code units."""
    s = _col(s)
    hex_ = F.hex(F.encode(s, "UTF-16BE"))
    at = F.sequence(F.lit(0), F.greatest(F.length(hex_) / 4 - 1, F.lit(0)).cast("int"))
    units = F.when(F.length(hex_) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(F.substring(hex_, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")))

    def poly(radix: int) -> Column:
        return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * radix % HASH_MOD + u) % HASH_MOD)

    number = s.try_cast("int")
    hashed = -(poly(HASH_RADIX_LOW).bitwiseAND(MASK_LOW).bitwiseXOR(poly(HASH_RADIX_HIGH).bitwiseAND(MASK_HIGH)))
    return F.when(number.isNotNull() & (number.cast("string") == s), number).otherwise(hashed.cast("int"))


def guess_uid(username: Column | str) -> Column:
    """A username of digits as an int; null otherwise, or where it is too great."""
    u = _col(username)
    return F.when(u.rlike("^[0-9]+$"), u.try_cast("int"))


def uid_from_style(style: Column | str) -> Column:
    """The id in an avatar's address: digits at the start of the last path step, before its first dot."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(_col(style), "/"), -1), r"^([0-9]+)[^.]*\.", 1), F.lit("")).try_cast("int")


def user_sign(s: Column | str) -> Column:
    """What stands inside one pair of outer parentheses, else null."""
    s = _col(s)
    return F.when(s.startswith("(") & s.endswith(")") & (F.length(s) >= 2), F.substring(s, F.lit(2), F.length(s) - 2))


def style_revision(html: Column | str, default: int = 398) -> Column:
    """The first style-sheet revision (css?r...) in a page's first 5000 characters."""
    return F.coalesce(F.nullif(F.regexp_extract(F.substring(_col(html), 1, 5000), r"css\?r(\d+)", 1), F.lit("")).try_cast("int"), F.lit(default))


def post_second(text: Column | str) -> Column:
    """Epoch seconds of ``yyyy-M-d HH:mm`` on the forum's clock (GMT+8); null if it isn't that."""
    t = F.try_to_timestamp(_col(text), F.lit("yyyy-M-d HH:mm"))
    return F.unix_timestamp(t.cast("timestamp_ntz").cast("timestamp")) - F.lit(8 * 3600)


def likes_script(html: Column | str) -> Column:
    """The object that a page assigns to data_likes_list, on its first such line; null without one."""
    return F.nullif(F.regexp_extract(_col(html), r"(?m)^[^\n]*?var data_likes_list = *(\{[^\n]*\});[^\n;]*$", 1), F.lit(""))


def post_state(html: Column | str) -> Column:
    """The state that a post's markup tells."""
    h = _col(html)
    tip, fold = h.startswith('<span class="tip'), h.startswith('<span class="post_content_collapsed">')
    return (
        F.when(tip & (h.contains("内容已被用户删除") | h.contains("删除了回复")), STATE["DELETED"])
        .when(tip & h.contains("违反") & h.contains("被删除"), STATE["ADMIN_DELETED"])
        .when(fold & h.contains("因含有") & h.contains("被折叠"), STATE["VIOLATIVE"])
        .when(fold & h.contains("回复被折叠"), STATE["COLLAPSED"])
        .otherwise(STATE["NORMAL"])
    )


def id_path(id_: Column | str) -> Column:
    """``aa/bb/id``: the directories in which a topic's file lies; a negative id is an error."""
    i = _col(id_).cast("bigint")
    path = F.format_string("%02d/%02d/%d", F.floor(i / 10_000), F.floor(i % 10_000 / 100), i)
    return F.when(i < 0, F.raise_error(F.lit("negative id"))).otherwise(path)


def topic_path(space: Column | str, id_: Column | str, suffix: str) -> Column:
    return F.concat(_col(space), F.lit("/"), id_path(id_), F.lit(suffix))


def path_space(path: Column | str) -> Column:
    """A path's first step: the space type's directory."""
    return F.split(_col(path), "/")[0]


def path_topic(path: Column | str) -> Column:
    """The id that a path's file is named after; null if it isn't one."""
    return F.element_at(F.split(F.element_at(F.split(_col(path), "/"), -1), r"\."), 1).try_cast("int")


def message_space(msg: Column | str) -> Column:
    """The space type in a commit message: its first word, in upper case."""
    return F.upper(F.split(_col(msg), " ")[0])


def timestamp_hint(msg: Column | str, committed: Column | str, authored: Column | str, strict: bool = False) -> Column:
    """Milliseconds after the message's last bar; without a number there, the earlier of the commit's two times.

    strict: a message without a bar is an error, unless it begins with META or init.
    """
    m = _col(msg)
    parts, own = F.split(m, r"\|"), F.least(_col(committed), _col(authored))
    hint = F.coalesce(F.trim(F.element_at(parts, -1)).try_cast("bigint"), own)
    if not strict:
        return hint
    bare = (F.size(parts) == 1) & ~m.rlike("(?i)^(meta|init)")
    return F.when(bare, F.raise_error(F.concat(F.lit("no timestamp in commit message: "), m))).otherwise(hint)


def on_air_second(text: Column | str) -> Column:
    """Epoch seconds (UTC midnight) of the day after ``首播:``; null without one."""
    day = F.try_to_date(F.trim(F.regexp_extract(_col(text), r"首播:(.+)$", 1)), "yyyy-MM-dd")
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400


def human_bytes(n: Column | str) -> Column:
    """``"%.1f XB"`` with decimal prefixes; plain bytes below 1000."""
    n = _col(n).cast("double")
    out = F.format_string("%.0f B", n)
    for k, unit in enumerate("kMGTPE", 1):
        out = F.when(F.abs(n) >= 1000.0**k, F.format_string(f"%.1f {unit}B", n / 1000.0**k)).otherwise(out)
    return out


def human_duration(ms: Column | str) -> Column:
    """``+1d 2h 3m 4s`` (or with a minus); parts before the first that isn't zero are left out."""
    x = _col(ms).cast("bigint")
    s = F.floor(F.abs(x) / 1000)
    d, h, m, sec = F.floor(s / 86_400), F.floor(s % 86_400 / 3600), F.floor(s % 3600 / 60), s % 60
    parts = F.concat_ws(" ", F.when(s >= 86_400, F.concat(d, F.lit("d"))), F.when(s >= 3600, F.concat(h, F.lit("h"))), F.when(s >= 60, F.concat(m, F.lit("m"))), F.concat(sec, F.lit("s")))
    return F.concat(F.when(x < 0, "-").otherwise("+"), parts)


def human_moment(ms: Column | str) -> Column:
    """A moment on the forum's clock, ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.timestamp_seconds(F.floor(_col(ms) / 1000) + 8 * 3600), "yyyy-MM-dd HH:mm:ss")


def has_flag(state: Column | str, flag: str) -> Column:
    return _col(state).bitwiseAND(STATE[flag]) == STATE[flag]


def is_empty_topic(state: Column | str, n_posts: Column | str, top: Column | str) -> Column:
    """Nothing to see: club or redirect or deleted, or no posts, or no top post (null, 0, -1)."""
    s, t = F.coalesce(_col(state), F.lit(0)), _col(top)
    return (s.bitwiseAND(STATE["BLOG_CLUB"] | STATE["BLOG_REDIRECT"] | STATE["DELETED"]) != 0) | (_col(n_posts) == 0) | t.isNull() | t.isin(0, -1)


def is_real_author(uid: Column | str, username: Column | str) -> Column:
    """Not the writer that pages without an author have: id 0, or a fixed name. An unknown id or name is somebody's."""
    return ~_col(uid).eqNullSafe(F.lit(0)) & ~_col(username).eqNullSafe(F.lit("_pseudo_writer"))


def for_display(html: Column | str, host: str, own_host: str, script: str) -> Column:
    """A stored page as it is shown: links to the forum's host become links here, a script is added at the end of the head."""
    here = F.replace(_col(html), F.lit(f"//{host}"), F.lit(f"//{own_host}"))
    return F.replace(here, F.lit("</head>"), F.lit(f'<script src="{script}"></script></head>'))
