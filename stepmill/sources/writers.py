"""Sinks. Tables go through Spark's commit protocol; small reports are written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(path: str, content: str, spark: SparkSession | None = None) -> None:
    """Atomic: a temporary file in the same folder is renamed over the target.

    With a session the path is one of the cluster's file systems, else one of this machine.
    """
    if spark is not None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
        out = tmp.getFileSystem(conf).create(tmp, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files = target.getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(tmp), files.makeQualified(target), options)
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def write_report(path: str, report: Mapping, spark: SparkSession | None = None) -> None:
    write_text(path, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n", spark)


def write_jsonl(df: DataFrame, path: str, canonical: bool = True, mode: str = "overwrite") -> None:
    """JSON lines, one file per partition; canonical puts the columns in order of their names and keeps NULLs."""
    cols = sorted(df.columns) if canonical else df.columns
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"} if canonical else {}).alias("value")).write.mode(mode).text(path)


def write_new(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses an existing path unless overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def swap_directory(df: DataFrame, path: str, manifest: Mapping) -> None:
    """A new version of a table beside the old one, then renamed into its place; the old one comes back if that fails."""
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = df.sparkSession._jsc.hadoopConfiguration()
    target, staging, backup = fs_path(path), fs_path(path + ".staging"), fs_path(path + ".old")
    fs = target.getFileSystem(conf)
    fs.delete(staging, True)
    df.write.mode("overwrite").parquet(path + ".staging")
    out = fs.create(fs_path(path + ".staging/_manifest.json"), True)
    out.write(bytearray((json.dumps(dict(manifest), sort_keys=True, default=str) + "\n").encode()))
    out.close()
    fs.delete(backup, True)
    had = fs.exists(target)
    if had and not fs.rename(target, backup):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staging, target):
        if had:
            fs.rename(backup, target)
        raise OSError(f"cannot replace {path}")
    fs.delete(backup, True)


def freeze_manifest(splits: Mapping[str, DataFrame], version: str, limit: int, tokens: str = "target_tokens") -> dict:
    """Checksums, rows and token percentiles per split; an error if a target exceeds the limit."""
    from stepmill.sources.readers import table_checksum

    out: dict = {"version": version, "splits": {}}
    for name, df in sorted(splits.items()):
        over = df.filter(F.col(tokens) > limit).count()
        if over:
            raise ValueError(f"{over} targets of {name} exceed {limit} tokens")
        c = table_checksum(df).first()
        p = df.agg(F.expr(f"percentile({tokens}, array(0.9D, 0.99D))").alias("p")).first()["p"] or [0.0, 0.0]
        out["splits"][name] = {"rows": c["rows"], "checksum": c["checksum"], "p90": p[0], "p99": p[1]}
    import hashlib

    body = {**{f"{k}_checksum": v["checksum"] for k, v in out["splits"].items()}, "version": version}
    out["dataset_checksum"] = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return out
