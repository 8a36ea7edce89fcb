"""Retrieval evaluation: case metrics, summaries, comparison gates, percentiles, replay differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.digests import tree_digest
from tidepool.functions.text import has_low_information
from tidepool.operators.routing import canonical_json


def case_metrics(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """One row per case: top1, recall, reciprocal_rank, keyword_coverage, noise, retrieved, empty.

    cases: case_id, titles and keywords (arrays). hits: case_id, rank, title, content. Hits are judged one by one;
    only ranks and matched titles and keywords are gathered.
    """
    top = hits.where(F.col("rank") <= k).join(cases, "case_id")
    good = F.array_contains("titles", F.col("title"))
    text = F.lower("content")
    judged = top.select(
        "case_id", F.when(good, F.col("rank")).alias("_rank"), F.when(good, F.col("title")).alias("_title"),
        F.filter("keywords", lambda w: text.contains(F.lower(w))).alias("_words"),
        has_low_information(F.col("title"), F.col("content")).cast("int").alias("_noise"))
    per = judged.groupBy("case_id").agg(
        F.count("*").alias("retrieved"), F.min("_rank").alias("_first"), F.count_distinct("_title").alias("_found"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_words")))).alias("_covered"), F.sum("_noise").alias("noise"))
    out = cases.join(per, "case_id", "left")
    return out.select(
        "case_id", (F.coalesce("_first", F.lit(0)) == 1).alias("top1"),
        F.coalesce(F.try_divide("_found", F.size("titles")), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.size("keywords") == 0, 1.0).otherwise(F.coalesce(F.col("_covered") / F.size("keywords"), F.lit(0.0))).alias("keyword_coverage"),
        F.coalesce("noise", F.lit(0)).cast("long").alias("noise"), F.coalesce("retrieved", F.lit(0)).cast("long").alias("retrieved"),
        F.col("retrieved").isNull().alias("empty"), (F.size("titles") > 0).alias("grounded"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: means over grounded cases, the no-answer rate over the others (null if none), the noise ratio."""
    mean = lambda c: F.avg(F.when(F.col("grounded"), F.col(c).cast("double")))
    return metrics.agg(
        F.count_if("grounded").alias("grounded"), mean("top1").alias("top1"), mean("recall").alias("recall"),
        mean("reciprocal_rank").alias("mrr"), mean("keyword_coverage").alias("keyword_coverage"),
        F.avg(F.when(~F.col("grounded"), F.col("empty").cast("double"))).alias("no_answer_rate"),
        (F.sum("noise") / F.greatest(F.sum("retrieved"), F.lit(1))).alias("noise_ratio"))


#: Metrics of which at least one has to rise.
_BETTER = ("top1", "recall", "mrr", "keyword_coverage")


def compare(baseline: DataFrame, candidate: DataFrame, latency_cap: float = 5.0) -> DataFrame:
    """One row: deltas (candidate - baseline, 4 places, missing counts as 0), failure reasons, passed.

    Both sides are one-row summaries, with latency_ms.
    """
    cols = (*_BETTER, "noise_ratio", "latency_ms")
    both = baseline.select(*[F.col(c).alias(f"_b_{c}") for c in cols]).join(candidate.select(*[F.col(c).alias(f"_c_{c}") for c in cols]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    delta = {c: F.round(zero(f"_c_{c}") - zero(f"_b_{c}"), 4).alias(f"delta_{c}") for c in cols}
    out = both.select(*delta.values())
    rose = F.greatest(*[F.col(f"delta_{c}") for c in _BETTER]) > 0
    reasons = F.array_compact(F.array(
        F.when(~rose, "no_positive_delta"), F.when(F.col("delta_noise_ratio") > 0, "noise_increased"),
        F.when(F.col("delta_latency_ms") > latency_cap, "latency_over_cap")))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.col("reasons") == "")


def percentiles(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, mean, p50, p95 and max, with linear interpolation, rounded to 3 places."""
    r = lambda c, name: F.round(c, 3).alias(name)
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"), r(F.min(value), "min"), r(F.avg(value), "mean"),
        r(F.percentile(value, 0.5), "p50"), r(F.percentile(value, 0.95), "p95"), r(F.max(value), "max"))


def replay_difference(before: Column, after: Column, most: int = 30) -> Column:
    """struct<added, removed>: locators in order, each once, capped."""
    distinct = lambda a, b: F.slice(F.array_except(a, b), 1, most)
    return F.struct(distinct(after, before).alias("added"), distinct(before, after).alias("removed"))


def judge_summary(judged: DataFrame) -> DataFrame:
    """One row: state and the means over completed cases, 4 places. judged: state, faithfulness, relevancy."""
    done, failed, n = F.count_if(F.col("state") == "completed"), F.count_if(F.col("state") == "failed"), F.count("*")
    state = (F.when((done > 0) & (failed > 0), "completed_with_failures").when(done > 0, "completed")
             .when(failed > 0, "failed").otherwise("skipped"))
    mean = lambda c: F.round(F.avg(F.when(F.col("state") == "completed", F.col(c))), 4).alias(c)
    return judged.agg(n.alias("cases"), done.alias("completed"), failed.alias("failed"), state.alias("state"), mean("faithfulness"), mean("relevancy"))


def incompatibilities(a: DataFrame, b: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """Names of the facts in which two one-row manifests differ."""
    both = a.select(*[F.col(c).alias(f"_a_{c}") for c in facts]).join(b.select(*[F.col(c).alias(f"_b_{c}") for c in facts]))
    differ = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), f"{c}_differs") for c in facts]
    return both.select(F.array_compact(F.array(*differ)).alias("reasons"))


def drifted_titles(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected titles that no document has."""
    wanted = cases.select("case_id", F.explode("titles").alias("title"))
    return wanted.join(documents.select("title").distinct(), "title", "left_anti").select("case_id", "title")


#: Settings that may differ between two evaluations that are to be compared, and those that make them incomparable.
IDENTITY = ("schema_version", "cases_sha256", "kb_id", "index_state", "graph_state", "embedding_model")


def manifest(cases: DataFrame, facts: dict[str, str]) -> DataFrame:
    """One row: a digest over all distinct cases, made as a tree so that no task gathers them, and the given facts."""
    own = F.sha2(canonical_json(F.to_json(F.struct(*cases.columns))), 256)
    digest = tree_digest(cases.select(F.lit(1).alias("_one"), F.concat_ws(":", "case_id", own).alias("_case")), ["_one"], "_case")
    one = cases.agg(F.count("*").alias("case_count")).withColumn("_one", F.lit(1)).join(digest, "_one", "left")
    none = F.sha2(F.lit(""), 256)
    return one.select(F.coalesce("digest", none).alias("cases_sha256"), "case_count").withColumns({k: F.lit(v) for k, v in facts.items()})


#: What each named experiment switches on.
STRATEGIES = {"baseline": (False, False), "rewrite": (True, False), "rerank": (False, True), "current": (True, True)}


def with_strategies(cases: DataFrame, names: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """Each case once for each strategy, with the switches query_rewrite and reranker."""
    rows = [F.struct(F.lit(n).alias("strategy"), F.lit(STRATEGIES[n][0]).alias("query_rewrite"), F.lit(STRATEGIES[n][1]).alias("reranker")) for n in names]
    return cases.select("*", F.inline(F.array(*rows)))


def community_algorithms(communities: DataFrame) -> DataFrame:
    """One row: algorithm -> communities, keys in order."""
    n = communities.groupBy("algorithm").count()
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("algorithm", "count")))).alias("algorithms"))
