"""Missing ids: holes, ranges, masks of 64-bit words, and samples of what to look at next.

Id sets are kept as rows or as (word number, 64 bits as a signed bigint). Consecutive-id logic
runs per slot of ids, so a type with billions of ids is not one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids per slot in which gaps are looked for; slots are stitched by their neighbours' ends.
SLOT = 1 << 16


def holes(ids: DataFrame, first: int = 1) -> DataFrame:
    """type, id of ids from ``first`` to the greatest of each type that don't occur.

    Gaps are taken between neighbours of a sort inside slots, with the last id of earlier slots
    from a window over slots; nothing is sorted by type as a whole, and no range is materialised
    but the holes themselves.
    """
    return ranges_to_ids(hole_ranges(ids, first))


def hole_ranges(ids: DataFrame, first: int = 1) -> DataFrame:
    """type, lo, hi of the maximal runs of missing ids from ``first`` to each type's greatest."""
    own = ids.where(F.col("id") >= first).select("type", F.col("id").cast("bigint").alias("id")).distinct()
    slotted = own.withColumn("slot", F.floor(F.col("id") / SLOT))
    ends = slotted.groupBy("type", "slot").agg(F.max("id").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.partitionBy("type").orderBy("slot"))).select("type", "slot", "before")
    prev = F.lag("id").over(Window.partitionBy("type", "slot").orderBy("id"))
    near = slotted.withColumn("prev", prev).join(before, ["type", "slot"])
    lo = F.coalesce("prev", "before", F.lit(first - 1)) + 1
    return near.select("type", lo.alias("lo"), (F.col("id") - 1).alias("hi")).where("lo <= hi")


def ranges_to_ids(ranges: DataFrame) -> DataFrame:
    """Every id of ranges; a long range is cut into slots, which are spread before they are spelled out."""
    pieces = ranges.select("type", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / SLOT), F.floor(F.col("hi") / SLOT))).alias("k"))
    lo, hi = F.greatest(F.col("lo"), F.col("k") * SLOT), F.least(F.col("hi"), (F.col("k") + 1) * SLOT - 1)
    return pieces.repartition("type", "k").select("type", F.explode(F.sequence(lo, hi)).alias("id"))


def ranges(ids: DataFrame) -> DataFrame:
    """type, lo, hi of the maximal runs of ids that do occur (gaps and islands, by slots).

    Runs are found inside slots. Only a run that touches its slot's first or last id can go on in a
    neighbour, and these, two per slot at most, are what a type's one sort sees.
    """
    own = ids.select("type", F.col("id").cast("bigint").alias("id")).distinct().withColumn("slot", F.floor(F.col("id") / SLOT))
    n = F.row_number().over(Window.partitionBy("type", "slot").orderBy("id"))
    parts = own.withColumn("k", F.col("id") - n).groupBy("type", "slot", "k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    edge = (F.col("lo") == F.col("slot") * SLOT) | (F.col("hi") == (F.col("slot") + 1) * SLOT - 1)
    w = Window.partitionBy("type").orderBy("lo")
    begins = F.coalesce((F.col("lo") != F.lag("hi").over(w) + 1).cast("int"), F.lit(1))
    joined = parts.where(edge).withColumn("b", begins).withColumn("run", F.sum("b").over(w)).groupBy("type", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.where(~edge).select("type", "lo", "hi").unionByName(joined.drop("run"))


def words(ids: DataFrame) -> DataFrame:
    """type, word_idx, word: ids as bits of words, from word 0 to the last one in use, zeros included."""
    got = ids.where("id >= 0").select("type", F.expr("id div 64").alias("word_idx"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bit"))
    used = got.groupBy("type", "word_idx").agg(F.bit_or("bit").alias("word"))
    tops = used.groupBy("type").agg(F.max("word_idx").alias("top"))
    every = ranges_to_ids(tops.select("type", F.lit(0).cast("bigint").alias("lo"), F.col("top").alias("hi"))).withColumnRenamed("id", "word_idx")
    return every.join(used, ["type", "word_idx"], "left").select("type", "word_idx", F.coalesce("word", F.lit(0)).alias("word"))


def word_ids(masks: DataFrame) -> DataFrame:
    """type, id of the bits that are set."""
    bits = masks.where("word <> 0").select("type", "word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    on = F.col("word").bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0
    return bits.where(on).select("type", (F.col("word_idx") * 64 + F.col("bit")).alias("id"))


def lines_to_words(lines: DataFrame, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Words from a text form with one long per line; lines that are no longs are dropped, which moves later words up."""
    ok = lines.withColumn("word", F.expr(f"try_cast(trim({text}) as bigint)")).where("word is not null")
    n = F.row_number().over(Window.partitionBy("type").orderBy(line_no)) - 1
    return ok.select("type", n.cast("bigint").alias("word_idx"), "word")


def merge_masks(old: DataFrame, new: DataFrame, visited: DataFrame) -> DataFrame:
    """(new and visited) or (old and not visited), word by word.

    "Not visited" reaches only as far as the visited mask has words: old bits beyond it are lost.
    """
    o, n, v = (m.select("type", "word_idx", F.col("word").alias(c)) for m, c in ((old, "o"), (new, "n"), (visited, "v")))
    both = v.join(n, ["type", "word_idx"], "left").join(o, ["type", "word_idx"], "left")
    zero = F.lit(0).cast("bigint")
    word = F.coalesce("n", zero).bitwiseAND(F.col("v")).bitwiseOR(F.coalesce("o", zero).bitwiseAND(F.bitwise_not(F.col("v"))))
    return both.select("type", "word_idx", word.alias("word"))


def xor_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits that are set in one of two masks only; a mask's missing words are 0."""
    both = a.select("type", "word_idx", F.col("word").alias("a")).join(b.select("type", "word_idx", F.col("word").alias("b")), ["type", "word_idx"], "full")
    zero = F.lit(0).cast("bigint")
    return both.select("type", "word_idx", F.coalesce("a", zero).bitwiseXOR(F.coalesce("b", zero)).alias("word"))


def mask_sizes(masks: DataFrame) -> DataFrame:
    """Bits set and bits held, per type."""
    return masks.groupBy("type").agg(F.sum(F.bit_count("word")).cast("bigint").alias("cardinality"), ((F.max("word_idx") + 1) * 64).alias("size"))


# The look-back window of recent holes, its longest run, the most taken, types left out.
RECENT_IDS, RECENT_RUN, RECENT_TAKE, SKIPPED_TYPES = 100, 35, 10, (11, 200, 300)


def recent_window_holes(ids: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """type, id of small holes near each type's greatest id, the last few of those not checked yet."""
    own = ids.where(~F.col("type").isin(*SKIPPED_TYPES)).select("type", F.col("id").cast("bigint").alias("id"))
    n = own.groupBy("type").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    n = n.withColumn("span", F.least(F.lit(RECENT_IDS), F.expr("n * 6 div 7"))).withColumn("take", F.least(F.expr("n div 8"), F.lit(RECENT_TAKE)))
    window = n.where("span > 0").select("type", "take", F.explode(F.sequence(F.col("top") - F.col("span") + 1, F.col("top"))).alias("id"))
    absent = window.join(own.distinct(), ["type", "id"], "left_anti")
    runs = absent.withColumn("k", F.col("id") - F.row_number().over(Window.partitionBy("type").orderBy("id")))  # at most 100 ids a type
    small = runs.withColumn("len", F.count("*").over(Window.partitionBy("type", "k"))).where(F.col("len") <= RECENT_RUN)
    if checked is not None:
        small = small.join(checked, ["type", "id"], "left_anti")
    last = F.row_number().over(Window.partitionBy("type").orderBy(F.col("id").desc()))
    return small.withColumn("n", last).where(F.col("n") <= F.col("take")).select("type", "id")


def big_hole_mask(normal: DataFrame, tops: DataFrame, least: int = 100) -> DataFrame:
    """type, id of the hidden mask: runs of more than ``least`` ids that aren't normal, id 0, and a sentinel.

    normal: type, id of topics in state 0; tops: type, top (greatest id). The sentinel is top + 2.
    """
    ends = tops.select("type", F.col("top").cast("bigint").alias("top"))
    edge = normal.select("type", F.col("id").cast("bigint").alias("id")).unionByName(ends.select("type", (F.col("top") + 1).alias("id")))
    big = hole_ranges(edge, 0).where(F.col("hi") - F.col("lo") >= least)
    extra = ends.select("type", F.explode(F.array(F.lit(0).cast("bigint"), F.col("top") + 2)).alias("id"))
    return ranges_to_ids(big).unionByName(extra).distinct()


def sample_size(wanted: Column, low: int = 10, high: int = 80) -> Column:
    return F.least(F.greatest(wanted, F.lit(low)), F.lit(high))


def spot_check_sample(unmasked: DataFrame, wanted: int, seed: int = 0, low: int = 10, high: int = 80) -> DataFrame:
    """type, id: for each type an unbiased sample of clamp(wanted, low, high) ids, all if there are fewer.

    The order is a hash of id and seed, so a seed gives the same sample at every run, however
    the rows are spread.
    """
    k = min(max(wanted, low), high)
    w = Window.partitionBy("type").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return unmasked.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("type", "id")


#: So many unchecked ids are the last ones of a type: all of them are taken, and its checked mask begins anew (a fixed value).
LAST_IDS = 64


def spot_check_round(unchecked: DataFrame, checked: DataFrame, wanted: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(what to look at, the checked mask afterwards), both type, id.

    unchecked: ids neither checked nor hidden. Of a type with at most LAST_IDS of them all are taken,
    and afterwards nothing of it is checked; of others `spot_check_sample` is, which joins the mask.
    """
    n = unchecked.groupBy("type").agg(F.count("*").alias("n"))
    last = n.where(F.col("n") <= LAST_IDS).select("type")
    rest = unchecked.join(last, "type", "left_anti")
    taken = unchecked.join(last, "type", "left_semi").select("type", "id").unionByName(spot_check_sample(rest, wanted, seed))
    mask = checked.select("type", "id").unionByName(taken).distinct().join(last, "type", "left_anti")
    return taken, mask


# Types whose mask always leaves id 0 clear, so that small holes are visited again.
REVISITED_TYPES = (8, 10, 21)


def hidden_mask(topics: DataFrame) -> DataFrame:
    """type, id of topics not to visit again: empty ones but redirects, and a sentinel after the greatest id.

    topics: type, id, empty, redirect (booleans).
    """
    hidden = topics.where("empty and not redirect").select("type", F.col("id").cast("bigint").alias("id"))
    ends = topics.groupBy("type").agg((F.max("id") + 1).cast("bigint").alias("id"))
    mask = hidden.unionByName(ends.select("type", "id")).distinct()
    return mask.where(~(F.col("type").isin(*REVISITED_TYPES) & (F.col("id") == 0)))


def max_ids(*known: DataFrame) -> DataFrame:
    """The greatest id of each type over several lists (type, id): topic lists, stored topics, file names."""
    every = known[0].select("type", F.col("id").cast("bigint").alias("id"))
    for k in known[1:]:
        every = every.unionByName(k.select("type", F.col("id").cast("bigint").alias("id")))
    return every.groupBy("type").agg(F.max("id").alias("id"))


def to_visit(sample: DataFrame, recent: DataFrame) -> DataFrame:
    """What a spot check looks at: the sample and the recent holes, each id once."""
    return sample.select("type", "id").unionByName(recent.select("type", "id")).distinct()
