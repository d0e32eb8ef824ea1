"""Queries over JSON files written from the tables, and over functions that no other query runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepmill.functions import calls, diff, text
from stepmill.operators import examples, sequence
from stepmill.plans import prompts
from stepmill.queries.core import ST, _schema_sql, _steps
from stepmill.session import shared_folder, table
from stepmill.sources import readers, writers

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STEP = "steps array<struct<phase string, tool string, arguments string, observation string, tool_success boolean>>"


@query("SELECT traj_id, instance_id, coalesce(len(steps), -1)::INT AS steps, md5(problem_statement) AS problem FROM trajectories")
def q_s6_jsonl_round_trip(spark, d):
    """Trajectories written as JSON lines with canonical keys and read with all fields required."""
    path = shared_folder(spark)
    writers.write_jsonl(table(spark, d, "trajectories").select("traj_id", "instance_id", "problem_statement", "steps"), path)
    r, rejects = readers.jsonl(spark, path, f"traj_id long, instance_id string, problem_statement string, {STEP}", ["traj_id", "instance_id", "problem_statement", "steps"])
    return readers.require_no_rejects(r, rejects).select("traj_id", "instance_id", F.coalesce(F.size("steps"), F.lit(-1)).alias("steps"), F.md5("problem_statement").alias("problem"))


@query("SELECT coalesce(array_to_string(list_sort([k for k in ['missing:instance_id'] if instance_id IS NULL]), ','), '') AS reasons, count(*) AS n FROM tasks GROUP BY 1")
def q_s8_jsonl_rejects(spark, d):
    """Tasks as JSON lines without their NULLs: lines that lack a required field go to the reject channel."""
    path = shared_folder(spark)
    table(spark, d, "tasks").select(F.to_json(F.struct("task_id", "instance_id")).alias("value")).write.text(path)
    r, rejects = readers.jsonl(spark, path, "task_id long, instance_id string", ["task_id", "instance_id"])
    g = r.select(F.lit("").alias("reasons")).unionByName(rejects.select(F.array_join("reasons", ",").alias("reasons")))
    return g.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


def _documents(spark, d):
    """One JSON file per held-out item, 240 whatever the scale."""
    path = shared_folder(spark)
    items = table(spark, d, "heldout_items").select("item_id", "instance_id", "kind", F.md5("text").alias("digest"))
    n = items.count()
    i = F.row_number().over(Window.orderBy("item_id")) - 1
    items.select(i.alias("i"), F.to_json(F.struct("item_id", "instance_id", "kind", "digest"), {"ignoreNullFields": "false"}).alias("value")).repartitionById(max(1, n), F.col("i")).select("value").write.text(path)
    return readers.json_documents(spark, path, "item_id long, instance_id string, kind string, digest string", "*.txt")


@query("SELECT item_id, instance_id, kind, md5(text) AS digest FROM heldout_items")
def q_s2_json_documents(spark, d):
    return readers.require_no_rejects(*_documents(spark, d)).select("item_id", "instance_id", "kind", "digest")


@query("SELECT item_id, 'unexpected' AS problem FROM heldout_items WHERE split = 'test' UNION ALL SELECT -1, 'missing'")
def q_s4_arm_problems(spark, d):
    """Records of an arm against the ids expected of it: here the validation items and one that does not exist."""
    records, _ = _documents(spark, d)
    expected = table(spark, d, "heldout_items").filter("split = 'validation'").select("item_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id")))
    return readers.arm(records, expected, "item_id")[1]


@query("SELECT item_id, kind FROM heldout_items")
def q_j2_by_file_name(spark, d):
    """Strict join of tasks and records by file name (S5): every task has its record, of the same id."""
    records, rejects = _documents(spark, d)
    return readers.condition(records, rejects, records.select("source_file", "item_id"), "item_id").select("item_id", "kind")


@query()
def q_p7_oracle_prompts(spark, d):
    t = table(spark, d, "trajectories")
    return t.select("traj_id", F.md5(prompts.oracle_prompt("problem_statement", "steps")).alias("prompt_md5"))


@query(f"WITH a AS (SELECT s.tool AS tool, s.arguments AS raw FROM (SELECT unnest(steps) AS s FROM trajectories)), b AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN raw END AS j FROM a), c AS (SELECT *, json_keys(j) AS k FROM b) SELECT tool, ({_schema_sql()}) IS NULL AS valid, count(*) AS n FROM c GROUP BY 1, 2")
def q_v3_arguments_valid(spark, d):
    s = table(spark, d, "trajectories").select(F.explode("steps").alias("s"))
    return s.groupBy("s.tool", calls.call_status(F.col("s.tool"), F.col("s.arguments")).isNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text = upper(text) AS same FROM documents WHERE text IS NOT NULL")
def q_e7_unified_diff(spark, d):
    """Whether the diff of a text to its capitals is empty."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", (diff.unified_diff(F.lit("a"), F.col("text"), F.upper("text")) == "").alias("same"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS prompt_tokens, greatest(1, (length(source) + 3) // 4)::BIGINT AS target_tokens, greatest(1, (length(text) + 3) // 4) + greatest(1, (length(source) + 3) // 4) <= 256 AS fits FROM documents WHERE text IS NOT NULL")
def q_t8_estimates(spark, d):
    e = examples.estimate_examples(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", "source"), "text", "source", 256)
    return e.select("doc_id", "prompt_tokens", "target_tokens", "fits")


@query(f"WITH {ST} SELECT rollout_id, step_index, row_number() OVER (PARTITION BY rollout_id ORDER BY step_index) - 1 AS position FROM st")
def q_w8_positions(spark, d):
    return sequence.number_rows(_steps(spark, d, "phase"), ["rollout_id"], ["step_index"]).select("rollout_id", "step_index", "position")


@query(r"""SELECT kind, coalesce(nullif(regexp_extract(text, '(?i)"tool"\s*:\s*"([^"]*)"', 1), ''), nullif(regexp_extract(text, '(?i)Action\s*:\s*([A-Za-z_][A-Za-z0-9_]*)', 1), '')) AS guess, count(*) AS n FROM documents GROUP BY 1, 2""")
def q_p18_guesses(spark, d):
    """What a text names as its action; NULL where only its beginning would be given."""
    g = text.guess_action(F.col("text"))
    named = F.when(F.col("text").rlike(r'(?i)"tool"\s*:\s*"[^"]+"|Action\s*:\s*[A-Za-z_]'), g)
    return table(spark, d, "documents").groupBy("kind", named.alias("guess")).agg(F.count(F.lit(1)).alias("n"))
