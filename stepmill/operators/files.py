"""Repository files as a table (repo, path, content): listing, reading line ranges, searching, navigation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive) with their line ends; NULL bounds are the file's."""
    lines = F.regexp_extract_all(content, F.lit(r"([^\n]*\n|[^\n]+$)"), 1)
    first = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.coalesce(end, F.size(lines)) - first + 1)), "")


def list_files(files: DataFrame, repo: str, n: int) -> DataFrame:
    """(repo, listing): the first n distinct paths in order and how many more there are.

    Only the n first of a repository are gathered; ranks come from a window over its distinct paths.
    """
    d = files.select(repo, "path").distinct()
    w = Window.partitionBy(repo).orderBy("path")
    top = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    shown = top.groupBy(repo).agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("l"))
    total = d.groupBy(repo).agg(F.count(F.lit(1)).alias("c"))
    more = F.when(F.col("c") > n, F.concat(F.lit("\n... "), (F.col("c") - n).cast("string"), F.lit(" more files"))).otherwise("")
    return shown.join(total, repo).select(repo, F.concat("l", more).alias("listing"))


def search_code(files: DataFrame, query: Column, largest: int = 2_000_000) -> DataFrame:
    """(repo, path, line, text) of the lines that contain the query as it is; larger files are left out as the tool does."""
    f = files.filter(F.octet_length("content") <= largest).select("repo", "path", query.alias("q"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return f.filter((F.col("q") != "") & F.contains("text", F.col("q"))).select("repo", "path", (F.col("i") + 1).alias("line"), "text")


def navigation_plan(ranges: DataFrame, key: str) -> DataFrame:
    """(key, step_index, tool, path, start, end): per file one listing of its folder (once per folder), then a read per range, then the patch."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    r = ranges.withColumn("folder", F.when(folder == "", ".").otherwise(folder))
    lists = r.groupBy(key, "folder").agg(F.min("path").alias("path")).select(key, "path", F.lit(0).alias("o"), F.lit("list_files").alias("tool"), F.col("folder").alias("target"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    reads = r.select(key, "path", F.lit(1).alias("o"), F.lit("read_file").alias("tool"), F.col("path").alias("target"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    patch = r.select(key).distinct().select(key, F.lit("￿").alias("path"), F.lit(2).alias("o"), F.lit("apply_patch").alias("tool"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    w = Window.partitionBy(key).orderBy("path", "o", "start", "target")
    return lists.unionByName(reads).unionByName(patch).withColumn("step_index", F.row_number().over(w) - 1).select(key, "step_index", "tool", F.col("target").alias("path"), "start", "end")
