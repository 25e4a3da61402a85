"""Small text files that lie beside the archive: lists of ids, timestamps, bit sets; and whole trees of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_list(lines: DataFrame) -> DataFrame:
    """repo, id of lines (repo, value) that are ints."""
    return lines.select("repo", F.trim("value").try_cast("int").alias("id")).where("id is not null").distinct()


def fullest_list(lines: DataFrame) -> DataFrame:
    """The ids, in order, of the repository whose list reaches the greatest id (of equal ones the first by name)."""
    ids = id_list(lines)
    best = ids.groupBy("repo").agg(F.max("id").alias("top")).orderBy(F.col("top").desc(), "repo").limit(1)
    return ids.join(best.select("repo"), "repo", "left_semi").select("id").orderBy("id")


def timestamps(lines: DataFrame) -> DataFrame:
    """id, ts of ``id:ts`` lines (line_no, value); other lines are dropped, of a repeated id the last line stands."""
    parts = F.split("value", ":")
    ok = lines.where(F.size(parts) == 2).select("line_no", F.trim(parts[0]).try_cast("int").alias("id"), F.trim(parts[1]).try_cast("bigint").alias("ts")).where("id is not null and ts is not null")
    return ok.groupBy("id").agg(F.max_by("ts", "line_no").alias("ts"))


def write_words(words: DataFrame, path: str) -> None:
    """A bit set as text, one signed long per line, in a folder per type; a type's words are one sorted file."""
    one = words.repartition("type").sortWithinPartitions("type", "word_idx")
    one.select("type", F.col("word").cast("string").alias("value")).write.mode("overwrite").partitionBy("type").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """type, line_no, text of what `write_words` wrote, for `lines_to_words`."""
    files = spark.read.text(path, wholetext=True).select("type", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("line_no", "text"))
    return files.where("text <> ''")


def tree(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """path, body of all files below a folder that end in suffix."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Pairs with scores as CSV, greatest first; a global sort, so files in order."""
    scores.orderBy(F.col("score").desc(), "a", "b").write.mode("overwrite").csv(path)


def jdbc(spark: SparkSession, url: str, name: str, partition_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of another database; read in parallel by ranges of a numeric column if it is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in options.items():
        r = r.option(k, v)
    if partition_by and bounds:
        r = r.option("partitionColumn", partition_by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()
