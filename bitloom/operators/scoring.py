"""Scoring annotators against a gold set: set F1, recall, consistency, group summaries, selection with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def set_f1(expected: Column, actual: Column) -> Column:
    """F1 of two sets given as arrays: 1 if both are empty, 0 if one is or nothing is shared."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    both = F.size(F.array_intersect(e, a))
    return F.when((F.size(e) == 0) & (F.size(a) == 0), 1.0).when((F.size(e) == 0) | (F.size(a) == 0), 0.0).otherwise(2.0 * both / (F.size(e) + F.size(a)))


def role_key(role: Column) -> Column:
    return F.struct(*(role[n].alias(n) for n in ("predicate", "role", "participant", "evidence_status")))


def preserved(ambiguity: Column, roles: Column) -> Column:
    """``predicate.role`` stays ambiguous: such roles exist, and none names a participant as a fact."""
    p, r = F.split_part(ambiguity, F.lit("."), F.lit(1)), F.regexp_replace(ambiguity, "\\A[^.]*\\.?", "")
    hit = F.filter(roles, lambda x: (x["predicate"] == p) & (x["role"] == r))
    return (F.size(hit) > 0) & F.forall(hit, lambda x: x["participant"].isNull() & (x["evidence_status"] == "ambiguous"))


def source_scores(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """provider, predicate_f1, role_f1, relation_f1, scope_f1, ambiguity_preservation_rate.

    ``gold``: case_id, predicates, roles, relations, scopes (JSON texts), ambiguities. ``runs``:
    provider, run, case_id and the same arrays, of valid outputs; rows with a null case_id stand for
    invalid runs. A case without output scores 0: as that adds nothing to a sum, outputs meet their
    case by its id, and sums are divided by runs times cases.
    """
    g = gold.select("case_id", *(F.col(c).alias(f"g_{c}") for c in ("predicates", "roles", "relations", "scopes", "ambiguities")))
    all_ = gold.agg(F.count("*").alias("cases"), F.coalesce(F.sum(F.size("ambiguities")), F.lit(0)).alias("doubts"))
    keys = lambda c: F.transform(c, role_key)
    kept = F.size(F.filter("g_ambiguities", lambda a: preserved(a, F.col("roles"))))
    per = runs.where("case_id is not null").join(g, "case_id").groupBy("provider").agg(
        F.sum(set_f1(F.col("g_predicates"), F.col("predicates"))).alias("p"), F.sum(set_f1(keys(F.col("g_roles")), keys(F.col("roles")))).alias("r"),
        F.sum(set_f1(F.col("g_relations"), F.col("relations"))).alias("l"), F.sum(set_f1(F.col("g_scopes"), F.col("scopes"))).alias("s"), F.sum(kept).alias("k"),
    )
    n = runs.groupBy("provider").agg(F.countDistinct("run").alias("runs"))
    j = n.join(per, "provider", "left").join(F.broadcast(all_))  # one row
    mean = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / (F.col("runs") * F.col("cases")), 6)
    rate = F.when(F.col("doubts") > 0, F.round(F.coalesce("k", F.lit(0)) / (F.col("runs") * F.col("doubts")), 6)).otherwise(1.0)
    return j.where("cases > 0").select("provider", mean("p").alias("predicate_f1"), mean("r").alias("role_f1"), mean("l").alias("relation_f1"), mean("s").alias("scope_f1"), rate.alias("ambiguity_preservation_rate"))


def review_scores(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """provider, blocking_recall, control_false_positive_rate.

    ``gold``: case_id, blocking_codes, control. ``runs``: provider, run, case_id, findings (code,
    severity), with a row of null case_id for an invalid run. Any finding on a control counts. Cases
    without findings add nothing to the sums, as in :func:`source_scores`.
    """
    g = gold.select("case_id", F.array_distinct("blocking_codes").alias("expected"), F.coalesce("control", F.lit(False)).alias("control"))
    all_ = g.agg(F.coalesce(F.sum(F.size("expected")), F.lit(0)).alias("codes"), F.count_if("control").alias("controls"))
    codes = F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"].isin("critical", "major")), lambda f: f["code"]))
    per = runs.where("case_id is not null").join(g, "case_id").groupBy("provider").agg(F.sum(F.size(F.array_intersect("expected", codes))).alias("hit"), F.count_if(F.col("control") & (F.size("findings") > 0)).alias("bad"))
    n = runs.groupBy("provider").agg(F.countDistinct("run").alias("runs"))
    j = n.join(per, "provider", "left").join(F.broadcast(all_))  # one row
    share = lambda c, d, empty: F.when(F.col(d) > 0, F.round(F.coalesce(F.col(c), F.lit(0)) / (F.col("runs") * F.col(d)), 6)).otherwise(empty)
    return j.select("provider", share("hit", "codes", 1.0).alias("blocking_recall"), share("bad", "controls", 0.0).alias("control_false_positive_rate"))


def consistency(runs: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """keys, consistency: share of (case, field) pairs that all runs agree on; 0 with an invalid run or fewer than two.

    ``runs``: keys, run, schema_valid, case_id and one canonical string per field in ``values``.
    """
    state = runs.groupBy(*keys).agg(F.countDistinct("run").alias("n"), F.bool_and("schema_valid").alias("valid"))
    one = F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).alias("value")) for v in values))).alias("x")
    long_ = runs.where("case_id is not null").select(*keys, "case_id", one).select(*keys, "case_id", "x.field", "x.value")
    same = long_.groupBy(*keys, "case_id", "field").agg((F.countDistinct("value") == 1).alias("same"))
    share = same.groupBy(*keys).agg(F.avg(F.col("same").cast("int")).alias("share"))
    ok = F.col("valid") & (F.col("n") >= 2)
    return state.join(share, keys, "left").select(*keys, F.when(ok, F.round(F.coalesce("share", F.lit(0.0)), 6)).otherwise(0.0).alias("consistency"))


def summaries(runs: DataFrame, keys: list[str], required_runs: int = 3) -> DataFrame:
    """Rates, latencies and costs per group; null where there is no figure."""
    n = F.count("*")
    return runs.groupBy(*keys).agg(
        n.alias("runs"),
        (n == required_runs).alias("run_count_valid"),
        F.round(F.count_if("schema_valid") / n, 6).alias("schema_valid_rate"),
        F.round(F.count_if("timed_out") / n, 6).alias("timeout_rate"),
        F.round(F.median("latency_seconds"), 6).alias("median_latency_seconds"),
        F.round(F.max("latency_seconds"), 6).alias("max_latency_seconds"),
        F.round(F.sum("estimated_cost"), 8).alias("total_estimated_cost"),
        F.round(F.median("estimated_cost"), 8).alias("median_estimated_cost_per_run"),
    )


def cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost by prices per million tokens; null where a price is missing."""
    return F.round((prompt_tokens * prompt_price + completion_tokens * completion_price) / 1e6, 8)


def run_sets(runs: DataFrame, keys: list[str], required: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """keys, complete, same_request: exactly the required runs, all of one request."""
    want = F.array(*map(F.lit, required))
    return runs.groupBy(*keys).agg((F.array_sort(F.collect_list("run")) == want).alias("complete"), (F.countDistinct("request_sha256") == 1).alias("same_request"))


def failure_kind(schema_valid: Column, timed_out: Column, http_status: Column, has_output: Column) -> Column:
    return F.when(timed_out, "timeout").when(http_status.isNotNull() & (http_status != 200), F.concat(F.lit("http_"), http_status.cast("string"))).when(has_output & ~schema_valid, "schema_invalid").when(~schema_valid, "provider_failure")


def select_best(summary: DataFrame, order: list[Column], partition: list[str], name: str = "provider") -> DataFrame:
    """partition, selected: the first by ``order`` of those that pass the gate (column hard_gate_pass); null on a tie or without any."""
    ranked = summary.withColumn("place", F.when(F.col("hard_gate_pass"), F.rank().over(Window.partitionBy(*partition, "hard_gate_pass").orderBy(*order))))
    first = F.collect_list(F.when(F.col("place") == 1, F.col(name)))
    return ranked.groupBy(*partition).agg(first.alias("f")).select(*partition, F.when(F.size("f") == 1, F.col("f")[0]).alias("selected"))
