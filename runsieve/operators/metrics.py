"""Aggregates over calls and classifications, and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CAUSES, NOT_FLAKE_CAUSES, VERDICTS


def nearest_rank(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at the nearest rank, halves to even, of the share of the sorted values; 0 of none.

    Equal values are counted first, so that only distinct ones are put in order.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy()))  # distinct values
    at = lambda share: F.rint(F.lit(share) * (F.col("all") - 1))
    return ranked.agg(*[F.coalesce(F.min(F.when(F.col("upto") > at(s), F.col("v"))), F.lit(0.0)).alias(k) for k, s in shares.items()])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def call_totals(calls: DataFrame) -> DataFrame:
    """One row over calls (kind, input_tokens, output_tokens, cost_usd, latency_ms, error)."""
    good = calls.filter((F.col("kind") == "classify") & F.col("error").isNull())
    sums = calls.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return sums.join(nearest_rank(good, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), F.lit(True))  # one row each


def cost_per_classification(calls: DataFrame, classifications: DataFrame) -> DataFrame:
    """One row: what all calls cost, for each classification; 0 of none."""
    spent = calls.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    return spent.join(classifications.agg(F.count("*").alias("n")), F.lit(True)).select(ratio(F.col("cost_usd"), F.col("n")).alias("cost_per_classification"))


def last_seen(executions: DataFrame, runs: DataFrame, before=None) -> DataFrame:
    """(test_id, last_seen): the latest start of a run (before one, if given) that shows the test."""
    some = runs if before is None else runs.filter(F.col("started_at") < F.lit(before))
    return executions.join(some.select("run_pk", "started_at"), "run_pk").groupBy("test_id").agg(F.max("started_at").alias("last_seen"))


def as_map(rows: DataFrame, column: str) -> DataFrame:
    """One row: a map from each value of the column (there are few) to how often it stands, by falling count in `ranked`."""
    entry = F.struct(F.col(column).cast("string").alias("key"), F.col("n").alias("value"))
    out = tally(rows.filter(F.col(column).isNotNull()), column).agg(F.collect_list(entry).alias("e"))
    ranked = F.array_sort("e", lambda x, y: F.when(x["value"] != y["value"], F.when(x["value"] > y["value"], -1).otherwise(1)).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return out.select(F.map_from_entries("e").alias("counts"), F.transform(ranked, lambda x: x["key"]).alias("ranked"))


def classification_totals(classifications: DataFrame) -> DataFrame:
    out = classifications.agg(
        F.count("*").alias("classifications"), F.count_if("abstained").alias("abstained"), F.count_if("cache_hit").alias("cache_hits")
    )
    n = F.col("classifications")
    return out.withColumn("abstention_rate", ratio(F.col("abstained"), n)).withColumn("cache_hit_rate", ratio(F.col("cache_hits"), n))


def tally(rows: DataFrame, column: str, without: str | None = None) -> DataFrame:
    rows = rows if without is None else rows.filter(F.col(column) != without)
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def verdict_counts(detections: DataFrame) -> DataFrame:
    """One row: how many of each verdict (zeros too), how many in all, how many merged with doubt."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return detections.agg(*counts, F.count("*").alias("total"), F.count_if("merged_uncertain").alias("merged_uncertain"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, classes=CAUSES) -> DataFrame:
    """(class, support, predicted, true_positives, precision, recall, f1) of every class, met or not."""
    labels = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("truth") == F.col("predicted")).cast("int").alias("h")),
        )
    )
    sums = rows.select(sides.alias("s")).groupBy("s.class").agg(
        F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("true_positives")
    )
    out = labels.join(sums, "class", "left").na.fill(0)
    hit = F.col("true_positives")
    out = out.withColumn("precision", ratio(hit, F.col("predicted"))).withColumn("recall", ratio(hit, F.col("support")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def report_scores(rows: DataFrame, unknown: str = "UNKNOWN", regression: str = "REAL_REGRESSION", not_flake=NOT_FLAKE_CAUSES) -> DataFrame:
    """One row over (truth, predicted, adversarial): shares of right, abstained and dangerous answers.

    Dangerous: a regression taken for a flake.
    """
    right, answered = F.col("truth") == F.col("predicted"), F.col("predicted") != unknown
    regress = F.col("truth") == regression
    out = rows.agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        F.count_if(~answered).alias("n_abstained"),
        F.count_if(answered).alias("n_answered"),
        F.count_if(answered & right).alias("n_answered_right"),
        F.count_if(regress).alias("n_regressions"),
        F.count_if(regress & ~F.col("predicted").isin(*not_flake)).alias("n_dangerous"),
        F.count_if("adversarial").alias("n_adversarial"),
        F.count_if(F.col("adversarial") & right).alias("n_adversarial_right"),
    )
    share = {
        "accuracy": ("n_right", "n"),
        "abstention_rate": ("n_abstained", "n"),
        "accuracy_when_answering": ("n_answered_right", "n_answered"),
        "dangerous_error_rate": ("n_dangerous", "n_regressions"),
        "adversarial_accuracy": ("n_adversarial_right", "n_adversarial"),
    }
    return out.withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in share.items()})


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.filter("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def where_better(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes with support in which report a recalls more than report b."""
    x = a.select("class", "support", F.col("recall").alias("recall_a"))
    return x.join(b.select("class", F.col("recall").alias("recall_b")), "class").filter("support > 0 AND recall_a > recall_b")


def proposal_totals(results: DataFrame) -> DataFrame:
    """One row over proposals (cache_hit, abstained, downgrade_reason, log): calls, hits, repairs, failures, and the mean
    cost of those that were proposed (gates left out)."""
    own = F.filter("log", lambda c: c["kind"] != "gate")
    cost = F.aggregate(own, F.lit(0.0), lambda s, c: s + F.coalesce(c["cost_usd"], F.lit(0.0)))
    asked = F.size(own) > 0
    out = results.agg(
        F.count("*").alias("proposals"),
        F.coalesce(F.sum(F.size("log")), F.lit(0)).alias("calls"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.sum(F.size(F.filter("log", lambda c: c["kind"] == "repair"))), F.lit(0)).alias("repairs"),
        F.count_if(F.col("downgrade_reason").isin("invalid_json", "schema_invalid", "unknown_cause", "empty_response")).alias("schema_failures"),
        F.count_if(F.col("abstained")).alias("abstained"),
        F.coalesce(F.avg(F.when(asked, cost)), F.lit(0.0)).alias("mean_cost_usd"),
    )
    return out.withColumn("cache_hit_rate", ratio(F.col("cache_hits"), F.col("proposals")))
