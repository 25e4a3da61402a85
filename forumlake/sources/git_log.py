"""Git history as a Spark source: one row per changed file of each commit, in batch and as a stream.

    spark.dataSource.register(GitLogSource)
    spark.read.format("git_log").option("path", repo).load()
    spark.readStream.format("git_log").option("path", repo).load()

Columns: seq (place in history, from 0), commit_id, committed and authored (ms), msg, path,
content. Deleted files are left out, a rename gives its new path, a file that can't be read
has empty content. Text that isn't UTF-8 is decoded by its byte order mark, or as one of CHARSETS.
Options: path (a repository every executor can reach), since (a commit to start after), first (or
a commit to start with, if since isn't given), file (only commits that changed this path), content
(false leaves it empty), batch_commits (commits per partition).

Only the list of commits is made on the driver; changes and contents are read in tasks, by
ranges of commits with two git processes for a range, so a partition can be computed again anywhere.
A stream's offset holds the last commit's id, so it goes on rightly if history was rewritten since.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq bigint, commit_id string, committed bigint, authored bigint, msg string, path string, content string"
#: Tried in turn where a text isn't UTF-8; the last one reads anything.
CHARSETS = ("gb18030", "shift_jis", "cp1252", "latin-1")
_COMMIT = re.compile(r"\x01([0-9a-f]{40,64})\0(\d+)\0(\d+)\0(.*?)\x02\0\n?", re.S)


def decode(raw: bytes) -> str:
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(charset, "replace")
    for charset in ("utf-8", *CHARSETS):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], input=given, capture_output=True, check=True).stdout


def commits(repo: str, since: str | None = None, first: str | None = None, file: str | None = None) -> list[str]:
    """Ids of commits, oldest first: after ``since``, else from ``first`` on, else all; of those that changed a file, if it is given."""
    start = [f"{since}..HEAD"] if since else ["HEAD"]
    try:
        ids = _git(repo, "rev-list", "--reverse", *start, *(["--", file] if file else [])).decode().split()
        if first and not since:
            kept = {first, *_git(repo, "rev-list", f"{first}..HEAD").decode().split()}
            ids = [c for c in ids if c in kept]
        return ids
    except subprocess.CalledProcessError:  # no commit yet
        return []


def changes(repo: str, ids: Sequence[str]) -> Iterator[tuple[str, int, int, str, list[str]]]:
    """(commit, committed ms, authored ms, message, changed paths) of commits; a root commit changes all its files."""
    form = "--format=%x01%H%x00%ct%x00%at%x00%B%x02"
    raw = _git(repo, "diff-tree", "--stdin", "--always", "--root", "-r", "-M", "--name-status", "-z", form, given="".join(f"{c}\n" for c in ids).encode()).decode("utf-8", "replace")
    found = list(_COMMIT.finditer(raw))
    ends = [m.start() for m in found[1:]] + [len(raw)]
    for m, end in zip(found, ends, strict=False):
        steps = raw[m.end() : end].split("\0")
        paths, i = [], 0
        while i < len(steps) and steps[i].strip():
            kind = steps[i].strip()[0]
            step = 3 if kind in "RC" else 2
            if kind != "D":
                paths.append(steps[i + step - 1])
            i += step
        yield m.group(1), int(m.group(2)) * 1000, int(m.group(3)) * 1000, m.group(4).strip(), paths


def blobs(repo: str, wanted: Sequence[tuple[str, str]]) -> Iterator[str]:
    """The texts of (commit, path)s, in order; empty where a file isn't there, or its path holds a line end."""
    if not wanted:
        return
    given = "\n".join(f"{c}:{p}" if "\n" not in p else "missing" for c, p in wanted)
    p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        from threading import Thread

        writer = Thread(target=lambda: (p.stdin.write(given.encode() + b"\n"), p.stdin.close()), daemon=True)
        writer.start()
        for _ in wanted:
            head = p.stdout.readline().rstrip(b"\n")
            size = head.rpartition(b" ")[2]
            if not size.isdigit():
                yield ""
                continue
            raw = p.stdout.read(int(size))
            p.stdout.read(1)
            yield decode(raw)
    finally:
        p.stdout.close()
        p.kill()
        p.wait()


class _Range(InputPartition):
    def __init__(self, first: int, ids: Sequence[str]):
        self.first, self.ids = first, list(ids)


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.repo = options["path"]
        self.since, self.first, self.file = options.get("since"), options.get("first"), options.get("file")
        self.with_content = options.get("content", "true").lower() != "false"
        self.step = int(options.get("batch_commits", "200"))

    def commits(self) -> list[str]:
        return commits(self.repo, self.since, self.first, self.file)

    def ranges(self, ids: Sequence[str], first: int = 0) -> list[_Range]:
        return [_Range(first + i, ids[i : i + self.step]) for i in range(0, len(ids), self.step)]

    def rows(self, part: _Range) -> Iterator[tuple]:
        found = {c: rest for c, *rest in changes(self.repo, part.ids)} if part.ids else {}
        flat = [(part.first + k, c, *found[c][:3], p) for k, c in enumerate(part.ids) if c in found for p in found[c][3] if self.file in (None, p)]
        texts = blobs(self.repo, [(r[1], r[5]) for r in flat]) if self.with_content else ("" for _ in flat)
        for r, text in zip(flat, texts, strict=True):
            yield *r, text


class GitLogReader(_Reader, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self.ranges(self.commits()) or [_Range(0, [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.rows(partition)


class GitLogStreamReader(_Reader, DataSourceStreamReader):
    """An offset is the last commit's id and how many rows of commits came before; both are kept with the stream."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0, "last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        ids = self.commits()
        return {"commits": len(ids), "last": ids[-1] if ids else ""}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        ids = commits(self.repo, start["last"], None, self.file) if start["last"] else self.commits()
        upto = ids.index(end["last"]) + 1 if end["last"] in ids else 0
        return self.ranges(ids[:upto], start["commits"]) or [_Range(0, [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to release."""


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> GitLogReader:
        return GitLogReader(self.options)

    def streamReader(self, schema: object) -> GitLogStreamReader:  # noqa: N802
        return GitLogStreamReader(self.options)
