"""Training examples: expansion of trajectories, context budget, label masks, sampling weights, padding."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.calls import canonical_json, target_status
from stepmill.functions.dims import PHASE_TOOLS
from stepmill.functions.text import strip, token_estimate
from stepmill.plans.prompts import chat_prompt, messages

TRUNCATED = "\n[TRUNCATED]"
PRIORITY = {"list_files": 0, "search_code": 1, "read_file": 2}


def repository_context(trajectories: DataFrame, key: str) -> DataFrame:
    """(key, context): the first observation per path of successful read_file steps, in order of first reading."""
    s = trajectories.select(key, F.posexplode("steps").alias("pos", "s")).filter("s.tool = 'read_file' AND s.tool_success")
    s = s.select(key, "pos", F.get_json_object("s.arguments", "$.path").alias("path"), F.coalesce("s.observation", F.lit("")).alias("text")).filter("path IS NOT NULL")
    first = s.groupBy(key, "path").agg(F.min(F.struct("pos", "text")).alias("f"))
    parts = F.array_sort(F.collect_list(F.struct("f.pos", F.concat(F.lit("### File: "), "path", F.lit("\n"), "f.text").alias("t"))))
    return first.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def sft_v1(trajectories: DataFrame, key: str, instruction: Column, answer: Column) -> DataFrame:
    """(key, instruction, input, trajectory, answer); actions are rendered as tool(arguments)."""
    t = trajectories.select(key, instruction.alias("instruction"), answer.alias("answer"), F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(F.coalesce(s["phase"], F.lit("")).alias("thought"), F.concat(F.coalesce(s["tool"], F.lit("")), F.lit("("), F.coalesce(s["arguments"], F.lit("{}")), F.lit(")")).alias("action"), F.coalesce(s["observation"], F.lit("")).alias("observation"))).alias("trajectory"))
    return t.join(repository_context(trajectories, key), key, "left").select(key, "instruction", F.coalesce("context", F.lit("")).alias("input"), "trajectory", "answer")


def expand_v1(records: DataFrame, key: str) -> DataFrame:
    """Next-action examples of SFT v1 records: (key, example_index, prompt, target); N steps give N, an answer one more."""
    base = F.concat_ws("\n\n", F.concat(F.lit("Instruction: "), F.coalesce("instruction", F.lit(""))), F.when(F.col("input") != "", F.concat(F.lit("Repository:\n"), "input")))
    line = lambda s: F.concat(F.lit("Thought: "), s["thought"], F.lit("\nAction: "), s["action"], F.lit("\nObservation: "), s["observation"])
    n = F.size("trajectory")
    done = lambda i: F.when(i > 0, F.concat(F.lit("\n\nCompleted steps:\n"), F.array_join(F.transform(F.slice("trajectory", F.lit(1), i), line), "\n\n"))).otherwise("")
    count = n + F.when(strip(F.coalesce("answer", F.lit(""))) != "", 1).otherwise(0)
    r = records.select(key, base.alias("base"), "trajectory", "answer", F.explode(F.filter(F.sequence(F.lit(0), count), lambda i: i < count)).alias("example_index"))
    i = F.col("example_index")
    step = F.get("trajectory", i)
    target = F.when(step.isNull(), F.concat(F.lit("Final Answer: "), "answer")).otherwise(F.concat(F.lit("Thought: "), step["thought"], F.lit("\nAction: "), step["action"]))
    return r.select(key, "example_index", F.concat("base", done(i)).alias("prompt"), target.alias("target"))


def drop_oldest(examples: DataFrame, key: str, order: str, tokens: str, budget: int, keep: int = 0) -> DataFrame:
    """Items that stay when the oldest are dropped until the rest fits: a suffix sum per key. The newest `keep` always stay."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    s = examples.withColumn("suffix_tokens", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.row_number().over(w))
    return s.filter((F.col("suffix_tokens") <= budget) | (F.col("__r") <= keep)).drop("__r")


def _size(item: dict) -> int:
    return max(1, (len(json.dumps(item, ensure_ascii=False, sort_keys=True)) + 3) // 4)


def fit_history(history: list[dict], room: int, keep: int = 4, floor: int = 256, size=_size) -> tuple[list[dict], int, list[dict]] | None:
    """(history, removed, truncations) within `room` tokens; None if nothing can make it fit.

    First the oldest items go while more than `keep` are left, then observations are halved (cut at line ends, the tools of
    least worth first, not below `floor` characters), then the oldest go again. Sizes are kept, so only what changes is
    measured again.
    """
    items = [(i, dict(h)) for i, h in enumerate(history)]
    sizes = [size(h) for _, h in items]
    total, start, cut = sum(sizes), 0, {}
    while len(items) - start > keep and total > room:
        total -= sizes[start]
        start += 1
    for i, h in sorted(items[start:], key=lambda x: (PRIORITY.get(x[1].get("tool"), 3), x[0])):
        limit = original = len(h.get("observation") or "")
        while total > room and limit > floor:
            limit = max(floor, limit // 2)
            head = h["observation"][: max(0, limit - len(TRUNCATED))]
            at = head.rfind("\n")
            h["observation"] = (head[:at] if at > 0 else head) + TRUNCATED
            total += (now := size(h)) - sizes[i]
            sizes[i] = now
        if limit < original:
            cut[i] = {"history_index": i, "tool": h.get("tool"), "original_chars": original, "final_chars": len(h["observation"])}
    while start < len(items) and total > room:
        total -= sizes[start]
        cut.pop(start, None)
        start += 1
    return ([h for _, h in items[start:]], start, [cut[k] for k in sorted(cut)]) if total <= room else None


def fit_budget(steps: DataFrame, key: str, budget: int, keep: int = 4, floor: int = 256, protected: str | None = None) -> DataFrame:
    """Per step of a trajectory what of its history fits `budget` tokens beside its target and the protected prompt.

    (key, step_index, original_tokens, final_tokens, removed_history_steps, truncated_observations, history): history is
    the JSON of what is left. `protected` names a column with the tokens of the prompt that may not be cut (system,
    schemas, issue, phase). One trajectory is one group; each keeps at most its own steps in memory. Steps whose target
    and protected prompt alone are too long have NULL final_tokens and history.
    """
    schema = f"`{key}` {steps.schema[key].dataType.simpleString()}, step_index int, original_tokens long, final_tokens long, removed_history_steps int, truncated_observations array<struct<history_index:int,tool:string,original_chars:long,final_chars:long>>, history string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step_index", kind="stable")
        rows = [{"tool": t, "arguments": a or "", "observation": o or ""} for t, a, o in zip(pdf["tool"], pdf["arguments"], pdf["observation"])]
        before, out = 0, []
        for i, (k, n, fixed) in enumerate(zip(pdf[key], pdf["step_index"], pdf["__fixed"])):
            target = int(fixed) + _size({"arguments": rows[i]["arguments"], "tool": rows[i]["tool"]})
            total = before + target
            before += _size(rows[i])
            if target > budget:
                out.append((k, n, total, None, None, [], None))
                continue
            items, removed, cut = (rows[:i], 0, []) if total <= budget else fit_history(rows[:i], budget - target, keep, floor)
            out.append((k, n, total, target + sum(map(_size, items)), removed, cut, json.dumps(items, ensure_ascii=False, sort_keys=True)))
        res = pd.DataFrame(out, columns=[key, "step_index", "original_tokens", "final_tokens", "removed_history_steps", "truncated_observations", "history"])
        return res.astype({"final_tokens": "Int64", "removed_history_steps": "Int32"})

    fixed = F.col(protected) if protected else F.lit(0)
    return steps.select(key, "step_index", "tool", "arguments", "observation", F.coalesce(fixed, F.lit(0)).cast("long").alias("__fixed")).groupBy(key).applyInPandas(run, schema)


def build_v2(trajectories: DataFrame, key: str, budget: int, keep: int = 4, floor: int = 256) -> DataFrame:
    """One example per step: (key, step_index, phase, prompt, target, sha256, original_tokens, final_tokens, removed_history_steps, truncated_observations, error).

    trajectories: key, problem_statement, steps. The prompt holds the issue, the phase, its tools and the history that
    fits; the target is the call as canonical JSON. error is the first of schema_invalid (a call that its phase or schema
    forbids), target_over_budget and future_action_leakage (the target stands in the prompt), else NULL.
    """
    tools = F.create_map(*[x for p, ts in PHASE_TOOLS.items() for x in (F.lit(p), F.array(*(F.lit(t) for t in ts)))])
    s = trajectories.select(key, F.coalesce("problem_statement", F.lit("")).alias("problem"), F.posexplode("steps").alias("step_index", "s"))
    s = s.select(key, "problem", "step_index", "s.phase", "s.tool", "s.arguments", "s.observation")
    fixed = chat_prompt(messages(F.col("problem"), F.col("phase"), F.coalesce(tools[F.col("phase")], F.array().cast("array<string>"))))
    fitted = fit_budget(s.withColumn("fixed", token_estimate(fixed)), key, budget, keep, floor, "fixed")
    d = fitted.join(s.drop("observation"), [key, "step_index"])
    history = F.when(F.col("history") != "[]", F.col("history"))
    prompt = chat_prompt(messages(F.col("problem"), F.col("phase"), F.coalesce(tools[F.col("phase")], F.array().cast("array<string>")), history))
    target = F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"tool":'), F.coalesce(F.concat(F.lit('"'), "tool", F.lit('"')), F.lit("null")), F.lit("}"))
    d = d.withColumn("prompt", prompt).withColumn("target", target).withColumn("sha256", F.sha2(F.concat_ws("\n", "prompt", "target"), 256))
    error = F.when(target_status(F.col("phase"), F.col("tool"), F.col("arguments")).isNotNull(), "schema_invalid").when(F.col("final_tokens").isNull(), "target_over_budget").when(F.contains("prompt", F.col("target")), "future_action_leakage")
    return d.withColumn("error", error).select(key, "step_index", "phase", "prompt", "target", "sha256", "original_tokens", "final_tokens", "removed_history_steps", "truncated_observations", "error")


def audited_v2(examples: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(examples, rejections): a trajectory with one bad step gives no example but a row (key, step_index, error) of its first."""
    bad = examples.filter("error IS NOT NULL").groupBy(key).agg(F.min(F.struct("step_index", "error")).alias("e")).select(key, "e.step_index", "e.error")
    return examples.join(bad.select(key), key, "left_anti"), bad


def mask_labels(df: DataFrame, prompt_ids: str, full_ids: str) -> DataFrame:
    """Adds attention_mask and labels: -100 over the prompt, the ids over the target. prefix_ok tells whether the prompt is a prefix with a target after it."""
    n = F.size(prompt_ids)
    ok = (F.slice(F.col(full_ids), F.lit(1), n) == F.col(prompt_ids)) & (F.size(full_ids) > n)
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(full_ids))).withColumn("labels", F.concat(F.array_repeat(F.lit(-100), n), F.slice(F.col(full_ids), n + 1, F.size(full_ids)))).withColumn("prefix_ok", ok)


def keep_last(c: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), n)


def pad_batch(df: DataFrame, batch: str, ids: str, labels: str, pad_id: int) -> DataFrame:
    """Right-padded input_ids, attention_mask and labels up to the longest of the batch."""
    top = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = lambda c, v, n: F.concat(c, F.array_repeat(F.lit(v), n))
    d = df.withColumn("__n", top - F.size(ids))
    d = d.withColumn("attention_mask", fill(F.array_repeat(F.lit(1), F.size(ids)), 0, F.col("__n")))
    return d.withColumn(ids, fill(F.col(ids), pad_id, F.col("__n"))).withColumn(labels, fill(F.col(labels), -100, F.col("__n"))).drop("__n")


def balanced_weights(df: DataFrame, group: str) -> DataFrame:
    """Adds weight = 1 / rows of the group. The counts are aggregated and joined back, so no group has to fit a task."""
    counts = df.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.alias("d").join(counts.alias("c"), F.col(f"d.{group}").eqNullSafe(F.col(f"c.{group}"))).select("d.*", "c.weight")


def weighted_sample(df: DataFrame, weight: str, draws: int, key: str, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """`draws` seeded draws with replacement: the drawn rows with `times`, how often each was drawn; the times add up to `draws`.

    Rows fall into buckets by the hash of their key; a draw finds its bucket among the buckets' cumulative weights (a
    table of `buckets` rows) and its row by the cumulative weights inside the bucket, so nothing is sorted as a whole.
    Rows of NULL or no weight are never drawn; without any weight there are no draws.
    """
    spark = df.sparkSession
    d = df.filter(F.col(weight) > 0).withColumn("__b", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)).cast("int"))
    w = Window.partitionBy("__b").orderBy(key)
    d = d.withColumn("__high", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__low", F.col("__high") - F.col(weight))
    sums = d.groupBy("__b").agg(F.max("__high").alias("__sum"))
    # one row with the buckets' cumulative weights as an array
    cumulated = sums.agg(F.array_sort(F.collect_list(F.struct("__b", "__sum"))).alias("s"))
    ends = F.transform("s", lambda x, i: F.struct(x["__b"].alias("b"), x["__sum"].alias("sum"), F.aggregate(F.slice("s", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["__sum"]).alias("end")))
    cumulated = cumulated.select(ends.alias("s"), F.lit(1).alias("one"))
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = spark.range(draws).select("id", u("bucket").alias("u"), u("row").alias("v"), F.lit(1).alias("one")).join(F.broadcast(cumulated), "one")
    at = F.col("u") * F.element_at("s", -1)["end"]
    hit = F.coalesce(F.get(F.filter("s", lambda x: x["end"] > at), F.lit(0)), F.element_at("s", -1))
    # draws of one bucket are counted by their place inside it before they meet the rows
    drawn = drawn.filter(F.size("s") > 0).select(hit.alias("h"), "v").select(F.col("h.b").alias("__b"), (F.col("v") * F.col("h.sum")).alias("__at"))
    times = d.select(key, "__b", "__low", "__high").join(drawn, "__b").filter("__at >= __low AND __at < __high").groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return df.join(times, key)


def expected_shares(df: DataFrame, group: str, weight: str) -> DataFrame:
    w = df.groupBy(group).agg(F.sum(weight).alias("w"))
    total = w.agg(F.sum("w").alias("t")).withColumn("one", F.lit(1))
    return w.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(group, (F.col("w") / F.col("t")).alias("share"))


def estimate_examples(df: DataFrame, prompt: str, target: str, budget: int) -> DataFrame:
    """Token estimates of prompt and target and whether both fit the budget."""
    p, t = token_estimate(F.col(prompt)), token_estimate(F.col(target))
    return df.withColumn("prompt_tokens", p).withColumn("target_tokens", t).withColumn("fits", p + t <= budget)


