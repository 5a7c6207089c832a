"""Keep-or-drop baselines over a global score order of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from loggrove.operators.ordering import ranked
from loggrove.operators.retention import PENALTY, RETENTION_TARGET, keep_or_drop, outcome, penalized_fitness

# --- fixed values ----------------------------------------------------------
SWEEP_PERCENTS = (1, 2, 5, 10, 20, 30, 40, 50)
RANDOM_TRIALS = 20


def score_order(table: DataFrame) -> DataFrame:
    """Blocks with ``rank`` by falling score (ties by id), the anomalies found so far
    and the extra lines kept so far."""
    return ranked(table, [F.col("anomaly_score").desc(), "block_id"], position="rank", totals={
        "anomalies_upto": F.col("is_anomaly").cast("long"), "extra_lines_upto": F.col("lines") - 1})


def blocks_for_percent(percent: float, blocks: int) -> int:
    return min(blocks, math.ceil(percent / 100.0 * blocks))


def top_k_percent(ordered: DataFrame, percents=SWEEP_PERCENTS) -> DataFrame:
    """The outcome of keeping the top k % for several k, from one ranked table."""
    blocks = ordered.count()
    cuts = F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("k_percent"), F.lit(blocks_for_percent(p, blocks)).alias("n")) for p in percents]))
    each = ordered.withColumn("_cut", cuts)
    return outcome(keep_or_drop(each, F.col("rank") <= F.col("_cut.n")).withColumn("k_percent", F.col("_cut.k_percent")), ["k_percent"])


def smallest_top_k_for_target(ordered: DataFrame, target: float = RETENTION_TARGET) -> float:
    """Smallest k % whose top-k finds ``target`` of the anomalies."""
    total = ordered.agg(F.max("anomalies_upto").alias("found"), F.count(F.lit(1)).alias("n")).first()
    if not total["found"]:
        return 0.0
    reached = ordered.where(F.col("anomalies_upto") / F.lit(total["found"]) >= F.lit(float(target))).agg(F.min("rank")).first()[0]
    return 100.0 * min(reached or total["n"], total["n"]) / total["n"]


def count_for_lines(ordered: DataFrame, budget: int, by: list[str] = ()) -> DataFrame:
    """How many blocks, taken in order, keep closest to ``budget`` lines: ``keep_blocks``
    per group (0 is allowed; the side below the budget wins a tie)."""
    sizes = ordered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    costed = ordered.join(F.broadcast(sizes), list(by)) if by else ordered.withColumn("_n", sizes.scalar())
    costed = costed.withColumn("_cost", F.col("_n") + F.col("extra_lines_upto"))
    under = F.col("_cost") < F.lit(budget)
    edges = costed.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.max(F.when(under, F.col("rank"))).alias("_below_rank"), F.max(F.when(under, F.col("_cost"))).alias("_below_cost"),
        F.min(F.when(~under, F.col("rank"))).alias("_above_rank"), F.min(F.when(~under, F.col("_cost"))).alias("_above_cost"))
    # Keeping no block costs n metadata lines: that is rank 0.
    zero_under = F.col("_n") < F.lit(budget)
    below_rank = F.coalesce("_below_rank", F.when(zero_under, F.lit(0)))
    below_cost = F.coalesce("_below_cost", F.when(zero_under, F.col("_n")))
    above_rank = F.when(~zero_under, F.lit(0)).otherwise(F.col("_above_rank"))
    above_cost = F.when(~zero_under, F.col("_n")).otherwise(F.col("_above_cost"))
    take_below = above_rank.isNull() | (F.lit(budget) - below_cost <= above_cost - F.lit(budget))
    return edges.select(*by, F.when(below_rank.isNotNull() & take_below, below_rank).otherwise(above_rank).cast("long").alias("keep_blocks"))


def top_k_matching_lines(ordered: DataFrame, budget: int) -> DataFrame:
    """Highest scores first, cut where the kept lines match ``budget``."""
    keep = count_for_lines(ordered, budget).first()["keep_blocks"]
    return outcome(keep_or_drop(ordered, F.col("rank") <= keep))


def random_order(table: DataFrame, trials: int = RANDOM_TRIALS, seed=0) -> DataFrame:
    """Every block once per trial, in that trial's reproducible random order."""
    each = table.withColumn("trial", F.explode(F.lit(list(range(trials))))).withColumn(
        "_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col("block_id"))))
    return ranked(each, ["_hash", "block_id"], within=("trial",), position="rank",
                  totals={"extra_lines_upto": F.col("lines") - 1}).drop("_hash")


def random_matching_lines(table: DataFrame, budget: int, trials: int = RANDOM_TRIALS, seed=0) -> DataFrame:
    """The outcome per trial of keeping random blocks up to ``budget`` lines."""
    ordered = random_order(table, trials, seed)
    cuts = count_for_lines(ordered, budget, ["trial"])  # one row per trial
    chosen = ordered.join(F.broadcast(cuts), "trial")
    return outcome(keep_or_drop(chosen, F.col("rank") <= F.col("keep_blocks")), ["trial"])


MEASURES = ("storage_saved_pct", "weighted_retention", "full_retention", "coverage", "flagged_retention")


def trial_summary(per_trial: DataFrame, target: float = RETENTION_TARGET, penalty: float = PENALTY) -> DataFrame:
    """Mean and (population) standard deviation of each measure over the trials."""
    agg = per_trial.agg(
        F.count(F.lit(1)).alias("n_trials"),
        *[F.avg(m).alias(m) for m in MEASURES], *[F.stddev_pop(m).alias(f"{m}_std") for m in MEASURES])
    return agg.withColumn("fitness", penalized_fitness(F.col("storage_saved_pct"), F.col("weighted_retention"), target, penalty)
                          ).withColumn("meets_target", F.col("weighted_retention") >= target)


def compare(tune: DataFrame, holdout: DataFrame, policy_outcome: DataFrame, trials: int = RANDOM_TRIALS, seed=0,
            target: float = RETENTION_TARGET) -> DataFrame:
    """All baselines on the held-out half beside the tuned policy; ``policy_better`` is
    a higher penalized saving."""
    shown = [*MEASURES, "fitness", "meets_target"]
    tuned = policy_outcome.first()
    order = score_order(holdout)
    k = smallest_top_k_for_target(score_order(tune), target)
    rows = [
        ("keep_all", outcome(keep_or_drop(holdout, F.lit(True)), (), target)),
        ("keep_flagged_only", outcome(keep_or_drop(holdout, F.col("is_flagged")), (), target)),
        ("top_k_percent_tuned", top_k_percent(order, [k])),
        ("top_k_percent_same_savings", top_k_matching_lines(order, tuned["kept_lines"])),
        ("random_sampling_same_savings", trial_summary(random_matching_lines(holdout, tuned["kept_lines"], trials, seed), target)),
    ]
    out = None
    for name, frame in rows:
        one = frame.select(F.lit(name).alias("baseline"), *shown)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("policy_better", F.lit(tuned["fitness"]) > F.col("fitness"))
