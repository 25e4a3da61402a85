"""Topic files: where they lie, and the post records that stand in them.

Paths come in several spellings of the same file (separators, case, ``./``, ``..``,
doubled slashes, trailing blanks or suffixes), bodies in several writings of the same
structure (records on lines, in a list, in a topic document, indented or not, cut off).
Everything here is a column expression and runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.schema import SPACE_TYPES

_NAMES = "|".join(SPACE_TYPES)
#: The last directory named after a space type, then anything, then <id>.json and perhaps more.
_TOPIC_FILE = rf"(?i)^(?:.*/)?({_NAMES})/(?:.*/)?([0-9]+)\.json[^/]*$"
#: An object with a user object inside, closed: what is cut off doesn't match.
_RECORD = r'\{[^{}]*?"user"\s*+:\s*+\{[^{}]*+\}[^{}]*+\}'
RECORD_SCHEMA = "id bigint, user struct<id: bigint>, mid bigint, state bigint, dateline bigint"


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without empty or ``.`` steps and outer blanks, ``x/..`` resolved."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\./)*/*(?:\./)*", "/")
    p = F.regexp_replace(p, r"^(?:\./|/)+", "")
    for _ in range(3):
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return p


def topic_file(path: Column) -> Column:
    """STRUCT<type INT, mid INT> of a topic file's path, null for any other file or null."""
    p = normal_path(path)
    name = F.lower(F.regexp_extract(p, _TOPIC_FILE, 1))
    types = F.create_map(*[F.lit(x) for kv in SPACE_TYPES.items() for x in kv])
    mid = F.regexp_extract(p, _TOPIC_FILE, 2).try_cast("int")
    return F.when(path.isNotNull() & (name != "") & mid.isNotNull(), F.struct(F.try_element_at(types, name).alias("type"), mid.alias("mid")))


def records(body: Column) -> Column:
    """ARRAY<STRUCT> of the records that stand complete in a file's body."""
    return F.transform(F.regexp_extract_all(body, F.lit(_RECORD), F.lit(0)), lambda r: F.from_json(r, RECORD_SCHEMA))


def topic_records(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Post records of all topic files: type, mid, id, uid, state, dateline, with repetitions.

    paths: id, file_relative_path; files: fid, body. type and mid come from the path, the rest
    from the record. Defined cases: a null path or body, a file that is no topic file, an empty
    file and an unfinished record give no row; a record without an integer id gives none;
    n_bytes isn't trusted and not read.
    """
    named = paths.select(F.col("id").alias("fid"), topic_file(F.col("file_relative_path")).alias("at")).where("at is not null")
    # records leave their bodies before the join, so it moves a few numbers each
    held = files.where(F.col("body").contains('"user"')).select("fid", F.explode(records(F.col("body"))).alias("r"))
    few = held.select("fid", F.col("r.id").try_cast("int").alias("id"), F.col("r.user.id").alias("uid"), F.col("r.state").alias("state"), F.col("r.dateline").alias("dateline"))
    r = few.where("id is not null").join(named, "fid")
    return r.select("at.type", "at.mid", "id", "uid", "state", "dateline")
