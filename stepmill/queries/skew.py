"""Queries of problem 4 (a few keys holding most records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepmill.operators.skew import eager_join, heavy_keys, repo_results
from stepmill.session import latest_steps, table


def p4_found(spark, d):
    joined = eager_join(table(spark, d, "steps").select("repo"), table(spark, d, "task_refs").select("repo"), "repo")
    return heavy_keys(joined, {"left": "steps", "right": "task_refs"}).select("table_name", F.col("key").alias("repo"))


def p4_repo_results(spark, d):
    # the length is taken before the shuffle, so that no observation is shuffled
    steps = table(spark, d, "steps").withColumn("observation_chars", F.length("observation"))
    return repo_results(latest_steps(steps, "repo", "recorded_at", "observation_chars"), table(spark, d, "task_refs"))


QUERIES = {"p4_found": p4_found, "p4_repo_results": p4_repo_results}

SQL = {
    "p4_found": """
WITH r AS (SELECT 'steps' AS table_name, repo FROM steps UNION ALL SELECT 'task_refs', repo FROM task_refs),
     t AS (SELECT table_name, count(*) AS total FROM r GROUP BY table_name)
SELECT r.table_name, r.repo FROM r JOIN t USING (table_name) WHERE r.repo IS NOT NULL
GROUP BY r.table_name, r.repo, t.total HAVING count(*) >= 0.05 * t.total""",
    "p4_repo_results": """
WITH v AS (SELECT rollout_id, step_index, arg_max({'repo': repo, 'recorded_at': recorded_at, 'n': length(observation)}, ingested_at) AS x
           FROM steps GROUP BY rollout_id, step_index),
     s AS (SELECT x.repo AS repo, count(*) AS steps, count(DISTINCT rollout_id) AS rollouts, median(x.n)::DOUBLE AS med, max(x.recorded_at) AS latest FROM v GROUP BY 1),
     t AS (SELECT repo, count(*) AS refs, count(DISTINCT instance_id) AS instances, count(DISTINCT source_file) AS files FROM task_refs GROUP BY 1)
SELECT coalesce(s.repo, t.repo) AS repo, coalesce(steps, 0) AS steps, coalesce(rollouts, 0) AS rollouts, med AS median_observation_chars, latest AS latest_step,
       coalesce(refs, 0) AS refs, coalesce(instances, 0) AS instances, coalesce(files, 0) AS files,
       CASE WHEN coalesce(s.repo, t.repo) IS NULL THEN 0 ELSE coalesce(steps, 0) * coalesce(refs, 0) END AS step_ref_pairs
FROM s FULL OUTER JOIN t ON s.repo IS NOT DISTINCT FROM t.repo""",
}
