"""Sources: JSON documents and JSON lines with a reject channel, directories, arms, checksums, incremental selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of one JSON object per file. rejects: source_file, reasons. Arrays, scalars and broken text are rejected."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    raw = raw.withColumn("reason", F.when(kind.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object"))
    ok = raw.filter("reason IS NULL").select("source_file", F.from_json("value", schema).alias("r")).select("source_file", "r.*")
    return ok, raw.filter("reason IS NOT NULL").select("source_file", F.array("reason").alias("reasons"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, required: Sequence[str] = (), strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines; blank lines are skipped. rejects: source_file, line, reasons.

    required fields must be present in the object (NULL counts as present). strict=False accepts every object.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*(F.lit(k) for k in required)), keys) if required and strict else F.array().cast("array<string>")
    reasons = F.when(keys.isNull(), F.array(F.lit("invalid_json"))).otherwise(F.transform(missing, lambda k: F.concat(F.lit("missing:"), k)))
    raw = raw.withColumn("reasons", reasons)
    ok = raw.filter(F.size("reasons") == 0).select("source_file", F.from_json("value", schema).alias("r")).select("source_file", "r.*")
    return ok, raw.filter(F.size("reasons") > 0).select("source_file", "value", "reasons")


def require_no_rejects(records: DataFrame, rejects: DataFrame) -> DataFrame:
    """Fail-fast reading: the records, or an error that names the first rejects."""
    bad = rejects.limit(3).collect()
    if bad:
        raise ValueError(f"rejected input: {[r.asDict() for r in bad]}")
    return records


def arm(records: DataFrame, expected: DataFrame, key: str = "instance_id") -> tuple[DataFrame, DataFrame]:
    """(records by key, problems) of one arm: the first file of a key holds; missing, unexpected and duplicate keys are reported."""
    from stepmill.operators.splits import set_differences

    cols = [c for c in records.columns if c != key]
    first = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), "source_file").alias("r")).select(key, "r.*")
    return first.join(expected.select(key).distinct(), key, "left_semi"), set_differences(expected, records, key)


def condition(records: DataFrame, rejects: DataFrame, tasks: DataFrame, key: str = "instance_id") -> DataFrame:
    """Strict reading of one condition: every task has the record of its file name and of its key, else an error."""
    from stepmill.operators.compare import join_by_file

    return join_by_file(tasks.select("source_file", key), require_no_rejects(records, rejects), key)


def first_files(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows in order of file name after an offset; an error if there are fewer."""
    out = df.orderBy("source_file").offset(offset).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} files")
    return out


def lookup(df: DataFrame, key: str, value, required: bool = True):
    row = df.filter(F.col(key) == value).limit(1).collect()
    if not row and required:
        raise KeyError(value)
    return row[0] if row else None


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file; the bytes are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_checksums(df: DataFrame) -> DataFrame:
    """sha256 of each row's canonical JSON (sorted keys, NULLs kept) in `row_sha256`."""
    cols = sorted(df.columns)
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def table_checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum) of a table in any order: counts and sums of the rows' hashes, combinable, nothing collected."""
    h = F.conv(F.substring("row_sha256", 1, 15), 16, 10).cast("decimal(38,0)")
    return row_checksums(df).select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")), 256).alias("checksum"))


def task_projection(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The six text columns of a task; NULL becomes '', hints fall back to hints_text."""
    cols = set(raw.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hints = F.coalesce(*(F.col(c).cast("string") for c in ("hints", "hints_text") if c in cols), F.lit(""))
    return raw.select(*keep, *(text(c).alias(c) for c in ("instance_id", "repo", "base_commit", "problem_statement", "test_patch")), hints.alias("hints"))


def source_lineage(df: DataFrame, name: str, revision: str, checksum: str) -> DataFrame:
    return df.withColumn("dataset_name", F.lit(name)).withColumn("dataset_revision", F.lit(revision)).withColumn("dataset_checksum", F.lit(checksum))


def pending(tasks: DataFrame, previous: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """Tasks without a terminal status (success, fail, error); with retry_errors those that ended in error too."""
    done = previous.filter(F.col("status").isin("success", "fail", *([] if retry_errors else ["error"]))).select(key).distinct()
    return tasks.join(done, key, "left_anti")
