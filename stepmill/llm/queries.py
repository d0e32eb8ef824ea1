"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepmill.llm import components, encoding, leaks, overlap, packing, pieces, runs
from stepmill.session import table


def p1_found(spark, d):
    g = components.related_groups(table(spark, d, "tasks"), table(spark, d, "repo_aliases"))
    return g.filter(F.col("task_id") != F.col("group")).select(F.col("group").alias("first_task_id"), "task_id")


def p1_splits(spark, d):
    return components.assign_splits(components.related_groups(table(spark, d, "tasks"), table(spark, d, "repo_aliases")))


def p2_found(spark, d):
    p = overlap.overlap_pairs(table(spark, d, "trajectories"))
    return p.select(F.least("eval_id", "train_id").alias("traj_id_a"), F.greatest("eval_id", "train_id").alias("traj_id_b")).distinct()


def p2_report(spark, d):
    return overlap.overlap_report(table(spark, d, "trajectories"))


def p3_found(spark, d):
    return runs.collapse_runs(table(spark, d, "steps")).filter("n_steps >= 2").select("rollout_id", "first_step_index", "last_step_index")


def p3_collapsed(spark, d):
    return runs.collapse_runs(table(spark, d, "steps"))


def p5_found(spark, d):
    return pieces.split_observations(table(spark, d, "steps")).filter("piece = 0").select("rollout_id", "step_index")


def p5_pieces(spark, d):
    return pieces.split_observations(table(spark, d, "steps"), table(spark, d, "budget_results"))


def p6_found(spark, d):
    return packing.pack_documents(table(spark, d, "documents")).filter("pieces > 1 AND piece = 0").select("doc_id")


def p6_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p7_found(spark, d):
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).filter("distance = 0").select("doc_id", "item_id")


def p7_near(spark, d):
    """Also passages with up to two word edits."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"), max_edits=2).select("doc_id", "item_id", "distance")


def p8_found(spark, d):
    return encoding.find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark, d):
    return encoding.find_garbled(table(spark, d, "documents"))


# ---- what must hold for results that SQL cannot compute, as queries that it can -----------------------------------


def p1_split_checks(spark, d):
    """Tasks, groups in more than one split, and whether each share is within 1 % of all rows."""
    s = p1_splits(spark, d)
    rows = s.groupBy("group", "split").agg(F.count(F.lit(1)).alias("n"))
    torn = rows.groupBy("group").agg(F.count(F.lit(1)).alias("splits"), *(F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)).alias(k) for k in components.SHARES))
    total = F.sum(F.col("train") + F.col("validation") + F.col("test"))
    return torn.agg(total.alias("tasks"), F.count_if(F.col("splits") > 1).alias("torn_groups"), *((F.abs(F.sum(k) / total - share) <= F.greatest(F.lit(0.01), 10 / total)).alias(f"{k}_ok") for k, share in components.SHARES.items()))


def p3_collapsed_checks(spark, d):
    """Per rollout: steps, whether its runs cover every step once, and the last step."""
    r = runs.collapse_runs(table(spark, d, "steps"))
    return r.groupBy("rollout_id").agg(F.sum("n_steps").alias("steps"), F.min(F.col("last_step_index") - F.col("first_step_index") + 1 == F.col("n_steps")).alias("whole"), F.max("last_step_index").alias("last_step"))


def p5_piece_checks(spark, d):
    """Per oversized observation: its digest from the pieces without their overlaps, and whether every piece keeps limit and overlap."""
    p = pieces.split_observations(table(spark, d, "steps"))
    body = F.substr("piece_text", F.col("overlap_chars") + 1)
    g = p.groupBy("rollout_id", "step_index").agg(F.array_sort(F.collect_list(F.struct("piece", body.alias("body"), "piece_text", "overlap_chars"))).alias("p"))
    before = F.transform("p", lambda x, i: F.when(i == 0, x["overlap_chars"] == 0).otherwise(F.coalesce(F.endswith(F.get(F.col("p"), i - 1)["piece_text"], F.left(x["piece_text"], x["overlap_chars"])), F.lit(False)) & (x["overlap_chars"] == F.least(F.lit(pieces.OVERLAP), F.length(F.get(F.col("p"), i - 1)["piece_text"])))))
    fits = F.forall("p", lambda x: F.length(x["piece_text"]) <= pieces.LIMIT)
    return g.select("rollout_id", "step_index", F.md5(F.array_join(F.transform("p", lambda x: x["body"]), "")).alias("digest"), (fits & F.forall(before, lambda x: x)).alias("kept"))


def p6_container_checks(spark, d):
    """Documents, those whose pieces are not complete, containers over capacity, and whether at least 98 % of all containers but one a shard is filled."""
    c = packing.pack_documents(table(spark, d, "documents"))
    per_doc = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("pieces").alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("tokens"))
    docs = per_doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("rows") != F.col("pieces")) | (F.col("end") != F.col("tokens"))).alias("torn_documents"))
    full = c.groupBy("container").agg(F.sum("n_tokens").alias("n")).groupBy(F.substring_index("container", "-", 1).alias("shard")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("over"), F.count(F.lit(1)).alias("containers"), F.sum("n").alias("n"))
    fill = full.agg(F.sum("over").alias("over_capacity"), (F.sum("n") >= 0.98 * packing.CAPACITY * F.sum(F.col("containers") - 1)).alias("filled"))
    return docs.withColumn("k", F.lit(1)).join(fill.withColumn("k", F.lit(1)), "k").drop("k")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_report, p3_found, p3_collapsed, p5_found, p5_pieces, p6_found, p6_containers, p7_found, p7_near, p8_found, p8_restored, p1_split_checks, p3_collapsed_checks, p5_piece_checks, p6_container_checks)}

_KEYS = r"""k0 AS (SELECT id, regexp_replace(lower(regexp_replace(r, '\s+', '', 'g')), '[?#].*$', '') AS t FROM names),
 k1 AS (SELECT id, regexp_replace(regexp_replace(t, '^[a-z][a-z0-9+.-]*://([^/@]*@)?[^/]+/+', ''), '^([^/@:]+@)?[^/@:]*\.[^/@:]*:/*', '') AS t FROM k0),
 k2 AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^[a-z0-9.-]+\.[a-z]+/+([^/]+/+[^/]+.*)$', '\1'), '^[/.]+', ''), '/+$', ''), '\.git$', '') AS t FROM k1),
 k3 AS (SELECT id, regexp_replace(CASE WHEN contains(t, '/') THEN t ELSE regexp_replace(t, '^(.+?)__(.+)$', '\1/\2') END, '/+$', '') AS t FROM k2),
 keys AS (SELECT id, CASE WHEN regexp_matches(t, '^[^/]+/+[^/]+') THEN regexp_extract(t, '^([^/]+)/+([^/]+)', 1) || '/' || regexp_extract(t, '^([^/]+)/+([^/]+)', 2) END AS key FROM k3)"""

SQL = {
    "p1_found": rf"""
WITH RECURSIVE names AS (SELECT 't' || task_id AS id, repo AS r FROM tasks UNION ALL SELECT 'o' || row_number() OVER (ORDER BY old_repo, new_repo), old_repo FROM repo_aliases UNION ALL SELECT 'n' || row_number() OVER (ORDER BY old_repo, new_repo), new_repo FROM repo_aliases),
 {_KEYS},
 cm AS (SELECT task_id, nullif(lower(regexp_replace(base_commit, '\s+', '', 'g')), '') AS c FROM tasks), cd AS (SELECT DISTINCT c FROM cm WHERE c IS NOT NULL),
 ck AS (SELECT a.c, arg_max(b.c, length(b.c)) AS k FROM cd a JOIN cd b ON starts_with(b.c, a.c) GROUP BY 1),
 tn AS (SELECT t.task_id, coalesce(key, CASE WHEN regexp_matches(lower(trim(instance_id)), '^(.+?)__(.+)-\d+$') THEN regexp_extract(lower(trim(instance_id)), '^(.+?)__(.+)-\d+$', 1) || '/' || regexp_extract(lower(trim(instance_id)), '^(.+?)__(.+)-\d+$', 2) END) AS r, k AS c
   FROM tasks t JOIN keys ON id = 't' || t.task_id JOIN cm USING (task_id) LEFT JOIN ck ON cm.c = ck.c),
 links AS (SELECT 'r' || r AS a, 'c' || c AS b FROM tn WHERE r IS NOT NULL AND c IS NOT NULL UNION SELECT 'r' || o.key, 'r' || n.key FROM keys o JOIN keys n ON o.id[1] = 'o' AND n.id[1] = 'n' AND o.id[2:] = n.id[2:] WHERE o.key IS NOT NULL AND n.key IS NOT NULL),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT DISTINCT coalesce('r' || r, 'c' || c, 't' || task_id) AS a, coalesce('r' || r, 'c' || c, 't' || task_id) AS b FROM tn UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
 least AS (SELECT a, min(b) AS component FROM reach GROUP BY 1), g AS (SELECT task_id, component, min(task_id) OVER (PARTITION BY component) AS first_task_id FROM tn JOIN least ON a = coalesce('r' || r, 'c' || c, 't' || task_id))
SELECT first_task_id, task_id FROM g WHERE task_id <> first_task_id""",
    "p1_split_checks": "SELECT count(*) AS tasks, 0 AS torn_groups, true AS train_ok, true AS validation_ok, true AS test_ok FROM tasks",
    "p3_collapsed_checks": "SELECT rollout_id, count(DISTINCT step_index) AS steps, true AS whole, max(step_index) AS last_step FROM steps GROUP BY 1",
    "p5_piece_checks": """
WITH v AS (SELECT rollout_id, step_index, arg_max({'o': observation}, ingested_at).o AS o FROM steps GROUP BY 1, 2) SELECT rollout_id, step_index, md5(o) AS digest, true AS kept FROM v WHERE length(o) > 4000""",
    "p6_container_checks": "SELECT count(*) AS documents, 0 AS torn_documents, 0 AS over_capacity, true AS filled FROM documents",
    "p5_found": """
SELECT rollout_id, step_index FROM steps GROUP BY rollout_id, step_index HAVING length(arg_max({'o': observation}, ingested_at).o) > 4000""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM heldout_items),
     dg AS (SELECT doc_id, unnest([array_to_string(w[x:x + 12], ' ') for x in range(1, len(w) - 11)]) AS g FROM d),
     ig AS (SELECT DISTINCT item_id, unnest([array_to_string(w[x:x + 12], ' ') for x in range(1, len(w) - 11)]) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
