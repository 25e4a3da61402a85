"""Prose or not: boosted trees on document statistics, learned from weak labels.

A sample of the corpus of bounded size is labelled by several weak signals (`signals`) that are sure
only in clear cases; hand-written seeds are added. Prose and junk of the sample are also put together, with the lesser part cut to a
known share, so that there are labelled cases near the middle. Trees fitted on the statistics of all
these (`statistics`, which the signals don't use) learn to judge; their scores become probabilities on
a holdout of texts checked by hand, which nothing is learned from. The model then reads every document.

Part of the model are tables of words and pairs of words, with their odds to stand in prose. So that
trees don't trust them more than they deserve, rows of one half of the sample are looked up in tables
of the other; and part of the rows come again without any table, so that trees can judge a language
that the sample doesn't have.

Distribution: the sample is chosen by a hash of doc_id with a threshold from the row count and put in
one order; what the driver gets is at most MOST_SAMPLED texts of at most LONGEST_SAMPLED characters.
The fitted model, some megabytes at most (BUCKETS), goes to the tasks. Statistics and scores are made
in one pass of Arrow batches over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm import boosting
from forumlake.llm.holdout import HOLDOUT
from forumlake.llm.seeds import JUNK, PROSE
from forumlake.llm.signals import weak_label
from forumlake.llm.statistics import NAMES, WordTables, learn_tables, statistics
from forumlake.session import ship, spread

#: Rows aimed at for the training sample, the most that are taken, and the most characters of one.
SAMPLE, MOST_SAMPLED, LONGEST_SAMPLED = 3_000, 6_000, 20_000
#: Characters that are counted at once; a longer text is counted alone.
AT_ONCE = 1_000_000


#: Statistics that grow or fall with a text's length alone; trees don't see them.
UNSEEN = ("word_variety",)
#: Beyond these, trees see no difference: long texts don't differ among each other, nor do texts that repeat little.
FLAT_FROM = {"log_chars": 6.0, "log_words": 5.0, "log_lines": 3.0, "longest_segment": 4.0, "longest_word": 4.0, "distinct_segment_share": 0.6, "distinct_line_share": 0.6}


def _seen(texts: Sequence[str], tables: WordTables | None = None) -> np.ndarray:
    """The statistics of texts as trees see them."""
    x = statistics(texts, tables)
    for name, most in FLAT_FROM.items():
        at = NAMES.index(name)
        x[:, at] = np.minimum(x[:, at], most)
    x[:, [NAMES.index(name) for name in UNSEEN]] = 0
    return x


@dataclass
class Model:
    trees: boosting.Trees
    tables: WordTables

    def probability(self, texts: Sequence[str]) -> np.ndarray:
        """The probability of each text, none of which is empty, to be mostly not prose."""
        return self.trees.probability(_seen(texts, self.tables))


def _is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts that aren't blank, as many at once as have AT_ONCE characters."""
    for b in batches:
        ids, texts, chars = [], [], 0
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if _is_blank(t):
                continue
            if texts and chars + len(t) > AT_ONCE:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(d)
            texts.append(t)
            chars += len(t)
        if texts:
            yield ids, texts


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, stats (array in the order of NAMES) of each document that isn't null or blank."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            stats = statistics(texts)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(NAMES), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], names=["doc_id", "stats"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, stats array<double>")


#: Shares of the lesser part in texts put together, taken in turn.
SHARES = (0.15, 0.25, 0.33, 0.4)
#: How often a short text comes in one that repeats it, taken in turn.
FLOODS = (6, 9, 14, 25, 50)


def put_together(prose: str, junk: str, share: float, most_prose: bool, glue: str) -> str:
    """A text of both, in which the lesser one is cut to a share of the whole."""
    much, little = (prose, junk) if most_prose else (junk, prose)
    cut = little[: int(len(much) * share / (1 - share))]
    return cut + glue + much if len(much) % 2 else much + glue + cut


def labelled_sample(documents: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of about `sample` documents that signals are sure of, in the order of a hash of doc_id.

    The same documents give the same list however they are partitioned.
    """
    grid, n = 1 << 20, documents.count()
    some = documents.select("doc_id", "text").where(F.length("text") <= LONGEST_SAMPLED)
    if n > sample:
        some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < max(1, grid * sample // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, t, weak_label(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not _is_blank(t)]
            d, t, y = zip(*[r for r in rows if r[2] is not None], strict=True) if any(r[2] is not None for r in rows) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.string()), pa.array(y, pa.int32())], names=["doc_id", "text", "label"])

    cores = documents.sparkSession.sparkContext.defaultParallelism
    rows = some.repartition(2 * cores, "doc_id").mapInArrow(run, "doc_id bigint, text string, label int")
    first = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MOST_SAMPLED).collect()
    return [(r.text, r.label) for r in first]


def training_set(labelled: Sequence[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and halves (0, 1): the labelled ones, each put together with the last one of the other label in its half, and some short ones repeated."""
    texts, label, half = [], [], []
    last: dict[tuple[int, int], str] = {}
    for k, (t, y) in enumerate(labelled):
        texts.append(t)
        label.append(y)
        half.append(k % 2)
        if len(t) <= 60:
            if y == 0 and k // 2 % 4 == 0:  # what comes over and over again says nothing, whatever it says once
                texts.append(("\n", " ", "")[k // 8 % 3].join([t.strip()] * FLOODS[k // 24 % len(FLOODS)]))
                label.append(1)
                half.append(k % 2)
            continue
        other = last.get((k % 2, 1 - y))
        last[k % 2, y] = t
        if other is not None:
            prose, junk = (t, other) if y == 0 else (other, t)
            for most_prose in (True, False):
                texts.append(put_together(prose, junk, SHARES[k // 2 % len(SHARES)], most_prose, ("\n", " ", "\n\n")[k % 3]))
                label.append(0 if most_prose else 1)
                half.append(k % 2)
    return texts, np.array(label), np.array(half)


def fit_model(labelled: Sequence[tuple[str, int]]) -> Model:
    """A model of labelled texts and the seeds, calibrated on the holdout; a text of the holdout isn't learned from."""
    held = frozenset(t for t, _ in HOLDOUT)
    rows = [r for r in [*((t, 0) for t in PROSE), *((t, 1) for t in JUNK), *labelled] if r[0] not in held]
    texts, label, half = training_set(rows)
    own, y = [t for t, _ in rows], np.array([k for _, k in rows])
    fold = np.arange(len(rows)) % 2
    x = np.zeros((len(texts), len(NAMES)))
    for k in (0, 1):
        tables = learn_tables([t for t, f in zip(own, fold, strict=True) if f != k], y[fold != k])
        mine = np.nonzero(half == k)[0]
        x[mine] = _seen([texts[i] for i in mine], tables)
    again = np.arange(0, len(texts), 3)
    bare = _seen([texts[i] for i in again])
    trees = boosting.fit(np.concatenate([x, bare]), np.concatenate([label, label[again]]).astype(float))
    tables = learn_tables(own, y)
    checked = _seen([t for t, _ in HOLDOUT], tables)
    return Model(boosting.calibrate(trees, checked, np.array([k for _, k in HOLDOUT], dtype=float)), tables)


def fit_classifier(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """`fit_model` on `labelled_sample`."""
    ship(documents.sparkSession)
    return fit_model(labelled_sample(documents, sample))


def junk_probability(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, junk (probability that the text is mostly not prose) of each text that isn't blank.

    documents: doc_id bigint, text string; other columns are ignored. Defined cases: null, empty
    and blank texts have no row; repeated rows come out as often as they come in; an empty table
    gives none.
    """
    ship(documents.sparkSession)
    fitted = model or fit_classifier(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fitted.probability(texts))], names=["doc_id", "junk"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, junk double")


def named_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and one double column for each statistic; those of the learned tables (the last five) are left out."""
    return document_statistics(documents).select("doc_id", *[F.col("stats")[i].alias(n) for i, n in enumerate(NAMES[:-5])])
