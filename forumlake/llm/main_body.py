"""The main body of pages: the contiguous region with the greatest score.

Every line gets a score, the sum of the weights of the tokens it is made of: words score mostly
positive, tags mostly negative, and so do the words of menus and notices. A linear scan finds the
contiguous lines with the greatest sum (the maximum-scoring subsequence), on any page, with or
without tags. The region's lines are the body. Inside it lie lines that show no text of a post
(author and date, floor numbers, signatures, buttons, adverts); the same tokens score these against
text, and they are left out. Nothing outside the region ever comes out.

Weights are learned from labelled pages (`page_labels`): each token has one for lines outside, for
text, and for other lines inside, fitted together as a softmax regression. A line's score is the log
odds of lying inside. Every labelled page is learned from twice, as it is and without its tags, so
that words carry weight of their own on pages that have none; without tags a signature is marked by
dashes, as plain text has it.

Distribution: no shuffle of large tables' pages (`session.spread` moves small ones). Learning takes a
bounded sample to the driver; its weights, at most MOST_WORDS + MOST_MARKS tokens, go to the tasks;
each page is read in one pass of its own, whole, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.page_labels import OTHER, SIGN, hand_labelled, labels_of
from forumlake.llm.page_lines import MARKUP, Fact, Lines, Reader
from forumlake.session import ship, spread

#: Pages of the corpus that are learned from, at most; none of them has more characters than that.
SAMPLE_PAGES, LONGEST_SAMPLED = 600, 100_000
#: Tokens of words and of markup that get weights, at most; the most frequent are kept of each.
MOST_WORDS, MOST_MARKS = 40_000, 10_000
#: A page labelled by hand counts as so many.
HAND_WEIGHT = 3.0
#: No line scores more than this for or against the region.
LIMIT = 6.0


def best_region(scores: Sequence[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the greatest sum; (0, -1) if none is positive.

    One pass: a running sum that falls to zero or below can't begin the best run. Of equal sums
    the first is taken, and no run begins or ends with zeros that add nothing.
    """
    best, at, run, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i)
    return at


#: Weights of tokens: for lines outside, text, and other lines inside. They are multiples of 2**-16, so
#: that their sums are exact in any order.
Weights = dict[str, tuple[float, float, float]]


def sums_of(weights: Weights, tokens: Iterable[str]) -> tuple[float, float, float]:
    """The three sums of some tokens; unknown ones count nothing."""
    a = b = c = 0.0
    for t in tokens:
        w = weights.get(t)
        if w:
            a += w[0]
            b += w[1]
            c += w[2]
    return a, b, c


def _vocabulary(rows: Counter) -> dict[str, int]:
    n: Counter[str] = Counter()
    for (tok, _), k in rows.items():
        for t in tok:
            n[t] += k
    seen = sorted((t for t, k in n.items() if k >= 2), key=lambda t: (-n[t], t))
    marks = [t for t in seen if t.startswith(("q:", "c:", "i:"))][:MOST_MARKS]
    words = [t for t in seen if not t.startswith(("q:", "c:", "i:"))][:MOST_WORDS]
    return {t: i for i, t in enumerate([*words, *marks])}


def fit(rows: Counter, epochs: int = 6, updates: int = 150, batch: int = 512, rate: float = 0.3, decay: float = 1e-5) -> Weights:
    """Softmax regression of labels on tokens by AdaGrad, in as many epochs as ask for `updates` at least.

    rows counts (frozenset of tokens, label). Same rows, same weights.
    """
    place = _vocabulary(rows)
    items = sorted(((sorted(place[t] for t in tok if t in place), y, k) for (tok, y), k in rows.items()), key=lambda r: (r[0], r[1]))
    items = [r for r in items if r[0]]
    table = np.zeros((len(place), 3))
    if not items:
        return {}
    size = np.array([len(r[0]) for r in items])
    flat = np.concatenate([r[0] for r in items])
    begin = np.cumsum(size) - size
    label = np.eye(3)[[r[1] for r in items]]
    weight = np.sqrt(np.array([r[2] for r in items], dtype=float))
    square = np.full_like(table, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(max(epochs, -(-updates * batch // len(items)))):
        perm = order.permutation(len(items))
        for at in range(0, len(perm), batch):
            pick = perm[at : at + batch]
            n = size[pick]
            ends = np.cumsum(n)
            tok = flat[np.repeat(begin[pick] - (ends - n), n) + np.arange(ends[-1])]
            s = np.add.reduceat(table[tok], ends - n)
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = np.repeat((p - label[pick]) * weight[pick, None], n, axis=0)
            grad = np.stack([np.bincount(tok, err[:, k], len(table)) for k in range(3)], axis=1) / len(pick) + decay * table
            square += grad**2
            table -= rate * grad / np.sqrt(square)
    return {t: tuple(w) for t, w in zip(place, (np.round(table * 65536) / 65536).tolist(), strict=True)}


def training_rows(pages: Sequence[tuple[str | None, str]]) -> Counter:
    """Counts of (tokens, label) over the lines of labelled pages (title, content) and those labelled by hand."""
    rows: Counter = Counter()

    reader = Reader()

    def add(title: str | None, content: str, labels: list[int], k: float) -> None:
        page = reader.read(content, title)
        for i, y in enumerate(labels):
            tok = page.tokens(i)
            rows[tok, min(y, OTHER)] += k
            bare = {t for t in tok if not t.startswith(MARKUP)}
            if len(bare) + 2 < len(tok) or y == SIGN:
                rows[frozenset({*bare, "i:", "h:0", "f:dashes"} if y == SIGN else {*bare, "i:", "h:0"}), min(y, OTHER)] += k

    for title, content, labels in hand_labelled():
        add(title, content, labels, HAND_WEIGHT)
    for (title, content), labels in zip(pages, labels_of([c for _, c in pages]), strict=True):
        if labels is not None:
            add(title, content, labels, 1.0)
    return rows


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample`` pages, the first by a hash of page_id, and the pages labelled by hand.

    The same table gives the same weights however it is partitioned. Without pages that their markup
    labels, the hand-labelled ones alone decide.
    """
    some = pages.select("page_id", "title", "contentHtml").where(F.col("contentHtml").isNotNull() & (F.length("contentHtml") <= LONGEST_SAMPLED))
    grid, n = 1 << 20, pages.count()
    if n > 4 * sample:  # by the row count, so that the ordering below sees a few times the sample
        some = some.where(F.pmod(F.xxhash64("page_id"), F.lit(grid)) < max(1, grid * 4 * sample // n))
    first = some.dropDuplicates(["page_id", "contentHtml"]).orderBy(F.xxhash64("page_id", F.lit(1)), "page_id", F.xxhash64("contentHtml"), "title").limit(sample)
    return fit(training_rows([(r.title, r.contentHtml) for r in first.select("title", "contentHtml").collect()]))


class Scanner:
    """Finds main bodies; remembers the sums of lines and of places that come again."""

    def __init__(self, weights: Weights):
        self.weights, self.reader = weights, Reader()
        self.lines: dict[Fact, tuple] = {}
        self.places: dict[tuple[str, ...], tuple] = {}

    def sums(self, page: Lines) -> np.ndarray:
        """For each line, the sums of its weights for lines outside, text, and other lines inside."""
        weights, known, places = self.weights, self.lines, self.places
        a, b = [], []
        for f, around in zip(page.facts, page.around, strict=True):
            x = known.get(f)
            if x is None:
                x = sums_of(weights, f.tokens)
                if len(known) < Reader.MOST and len(f.text) <= Reader.SHORT:
                    known[f] = x
            y = places.get(around)
            if y is None:
                y = sums_of(weights, around)
                if len(places) < Reader.MOST:
                    places[around] = y
            a.append(x)
            b.append(y)
        return np.array(a) + np.array(b)

    def region(self, page: Lines) -> tuple[int, int, np.ndarray]:
        """First and last line of the best region, and all lines' sums."""
        sums = self.sums(page)
        inside = np.logaddexp(sums[:, 1], sums[:, 2]) - sums[:, 0]
        return *best_region(np.clip(inside, -LIMIT, LIMIT).tolist()), sums

    def body_lines(self, content: str | None, title: str | None) -> list[int]:
        """Numbers, from 1, of the lines that show text of the main body.

        Null, empty and blank pages have none, nor has a page whose best region holds neither the
        topic's heading nor a dated line.
        """
        if not content or not content.strip():
            return []
        page = self.reader.read(content, title)
        start, end, sums = self.region(page)
        if not any(page.anchors[start : end + 1]):
            return []
        return [i + 1 for i in range(start, end + 1) if page.facts[i].text and sums[i, 1] > sums[i, 2]]


def body_lines(content: str | None, title: str | None, weights: Weights) -> list[int]:
    """`Scanner.body_lines` of one page."""
    return Scanner(weights).body_lines(content, title)


def main_body(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, line_no of the lines of each page's main body.

    pages: page_id bigint, title string, contentHtml string; other columns are ignored. A page
    that comes more than once is read once for each distinct content, and its lines come out once.
    Defined cases: see `Scanner.body_lines`; an empty table gives no row.
    """
    ship(pages.sparkSession)
    own = weights if weights is not None else learn_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own)
        for b in batches:
            ids, nos = [], []
            for p, t, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = scanner.body_lines(c, t)
                ids += [p] * len(got)
                nos += got
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["page_id", "line_no"])

    some = pages.select("page_id", "title", "contentHtml").where("contentHtml is not null and contentHtml <> ''")
    lines = spread(some, "page_id").mapInArrow(run, "page_id bigint, line_no int")
    return lines.dropDuplicates(["page_id", "line_no"])
