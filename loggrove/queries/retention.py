"""Normalizer, tiers, outcomes, policy sweeps and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import baselines, retention, sampling
from loggrove.operators.retention import Normalizer, Policy
from loggrove.queries.labeling import split_sql
from loggrove.queries.registry import query
from loggrove.queries.scored import order_blocks
from loggrove.queries.scoring import ratio
from loggrove.scratch import written

POLICY = Policy(0.6, 0.3, 0.1, 0.35, 0.2, 0.3)
POPULATION = [Policy(0.2 + 0.1 * (i % 7), 0.1 + 0.05 * (i % 5), 0.05 * (i % 3), 0.2 + 0.02 * (i % 20), 0.05 + 0.01 * (i % 11), 0.05 + 0.02 * (i % 13))
              for i in range(40)]


def halves(spark, folder):
    """Scored blocks split into tune and holdout, and the tune half's normalizer."""
    split = sampling.stratified_split(order_blocks(spark, folder), 0.5, label="true_label")
    split = written(split.withColumn("split", F.when(F.col("split") == "test", "holdout").otherwise("tune")), "halves")
    return split, Normalizer.fit(split.where("split = 'tune'"))


def tables(spark, folder):
    split, normalizer = halves(spark, folder)
    return retention.block_table(split, normalizer, ("split",))


def holdout(spark, folder):
    return tables(spark, folder).where("split = 'holdout'")


def d(value) -> str:
    return f"CAST({value!r} AS DOUBLE)"


GRID = "[" + ", ".join(d(i / 1000) for i in range(1001)) + "]"
SPLIT = f"(SELECT * EXCLUDE (split), CASE split WHEN 'test' THEN 'holdout' ELSE 'tune' END AS split FROM {split_sql(0.5)})"
NORMALIZER = f"""(SELECT min(anomaly_score) AS s0, max(anomaly_score) AS s1, min(ln(1 + event_frequency)) AS f0, max(ln(1 + event_frequency)) AS f1,
  quantile_cont(block_size, {GRID}) AS q FROM halves WHERE split = 'tune')"""
WITH = f"""WITH halves AS MATERIALIZED {SPLIT}, norm AS MATERIALIZED {NORMALIZER}, ranks AS MATERIALIZED (SELECT block_size,
    (len(list_filter(q, lambda x: x < block_size)) + len(list_filter(q, lambda x: x <= block_size))) / 2002.0 AS part_size
    FROM (SELECT DISTINCT block_size FROM halves), norm),
  parts AS MATERIALIZED (SELECT block_id, split, anomaly_score, least(greatest((anomaly_score - s0) / (s1 - s0), 0), 1) AS part_score,
    least(greatest((ln(1 + event_frequency) - f0) / (f1 - f0), 0), 1) AS part_frequency, CAST(part_size AS DOUBLE) AS part_size,
    CAST(is_error AS DOUBLE) AS error, event_frequency AS lines, true_label = 'Anomaly' AS is_anomaly, predicted_label = 'Anomaly' AS is_flagged
    FROM halves JOIN ranks USING (block_size), norm)"""


def decided_sql(source: str, weights: str, t_hot: str, t_warm: str, fraction: str, extra: str = "", credit: float = 0.5, ref: float = 0.25) -> str:
    return f"""(SELECT *, CASE tier WHEN 'HOT' THEN lines WHEN 'WARM' THEN 1 + summary ELSE 1 END AS kept,
      CASE tier WHEN 'HOT' THEN 1.0::DOUBLE WHEN 'WARM' THEN {d(credit)} * least(1.0, summary / ({d(ref)} * lines)) ELSE 0.0::DOUBLE END AS credit FROM (
      SELECT *, CASE WHEN tier = 'WARM' THEN CAST(round_even({fraction} * lines, 0) AS BIGINT) ELSE 0 END AS summary FROM (
      SELECT *, CASE WHEN importance >= {t_hot} THEN 'HOT' WHEN importance >= {t_warm} THEN 'WARM' ELSE 'COLD' END AS tier FROM (
      SELECT {extra}{source}.*, {d(0.8)} * ({weights}) + {d(0.2)} * error AS importance FROM {source}{' , pop' if extra else ''}))))"""


def weight_text(policy: Policy) -> str:
    a, b, c = policy.weights
    return f"{d(a)} * part_score + {d(b)} * part_frequency + {d(c)} * part_size"


def one_policy(source: str, policy: Policy = POLICY, credit: float = 0.5, ref: float = 0.25) -> str:
    return decided_sql(source, weight_text(policy), d(policy.t_hot), d(policy.t_warm), d(policy.summary_fraction), "", credit, ref)


def outcome_sql(decided: str, by: str = "", target: float = 0.95) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    tiers = ", ".join(
        f"count(*) FILTER (tier = '{t}') AS {t.lower()}_blocks, CAST(coalesce(sum(kept) FILTER (tier = '{t}'), 0) AS BIGINT) AS {t.lower()}_lines, "
        f"count(*) FILTER (tier = '{t}' AND is_anomaly) AS {t.lower()}_anomalies" for t in retention.TIERS)
    return f"""(SELECT * EXCLUDE (c, wc, hf, fl), storage_saved_pct - 1000.0 * greatest(0, {d(target)} - weighted_retention) AS fitness,
      weighted_retention >= {d(target)} AS meets_target FROM (
      SELECT *, 100.0 * (1.0 - kept_lines / total_lines) AS storage_saved_pct, {ratio('c', 'n_anomalies', '1.0')} AS weighted_retention,
        {ratio('hot_anomalies', 'n_anomalies', '1.0')} AS full_retention, {ratio('hot_anomalies + warm_anomalies', 'n_anomalies', '1.0')} AS coverage,
        {ratio('hf', 'fl', '1.0')} AS flagged_retention, {ratio('wc', 'warm_anomalies')} AS warm_credit_earned FROM (
      SELECT {lead}count(*) AS n_blocks, count(*) FILTER (is_anomaly) AS n_anomalies, CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(kept) AS BIGINT) AS kept_lines,
        {tiers}, coalesce(sum(credit) FILTER (is_anomaly), 0.0) AS c, coalesce(sum(credit) FILTER (is_anomaly AND tier = 'WARM'), 0.0) AS wc,
        count(*) FILTER (tier = 'HOT' AND is_flagged) AS hf, count(*) FILTER (is_flagged) AS fl FROM {decided} {group})))"""


@query(f"""WITH halves AS MATERIALIZED {SPLIT}, norm AS {NORMALIZER} SELECT s0 AS score_min, s1 AS score_max, f0 AS log_freq_min, f1 AS log_freq_max,
  i AS grid_place, q[i + 1] AS size_quantile FROM norm, (SELECT unnest(range(1001)) AS i)""")
def fitted_normalizer(spark, folder):
    split, normalizer = halves(spark, folder)
    fitted = split.where("split = 'tune'").agg(F.min("anomaly_score").alias("score_min"), F.max("anomaly_score").alias("score_max"))
    return fitted.select("score_min", "score_max", F.lit(normalizer.log_freq_min).alias("log_freq_min"),
                         F.lit(normalizer.log_freq_max).alias("log_freq_max"),
                         F.posexplode(F.lit(normalizer.size_quantiles)).alias("place", "size_quantile")).select(
        "score_min", "score_max", "log_freq_min", "log_freq_max", F.col("place").cast("long").alias("grid_place"), "size_quantile")


@query(f"{WITH} SELECT block_id, split, part_score, part_frequency, part_size FROM parts")
def normalized_parts(spark, folder):
    return tables(spark, folder).select("block_id", "split", "part_score", "part_frequency", "part_size")


@query(f"{WITH} SELECT block_id, importance, tier, summary, kept, credit FROM {one_policy('parts')}")
def tiers_and_kept_lines(spark, folder):
    return retention.decide(tables(spark, folder), POLICY).select("block_id", "importance", "tier", "summary", "kept", "credit")


@query(f"{WITH} SELECT * FROM {outcome_sql(one_policy('parts'), 'split')}")
def policy_outcome_per_half(spark, folder):
    return retention.evaluate_policy(tables(spark, folder), POLICY, ["split"])


MEMBERS = ", ".join(f"({i}, {', '.join(d(w) for w in p.weights)}, {d(p.t_hot)}, {d(p.t_warm)}, {d(p.summary_fraction)})" for i, p in enumerate(POPULATION))


@query(f"""{WITH}, pop(policy_id, w1, w2, w3, th, tw, fr) AS (VALUES {MEMBERS}), tune AS (SELECT * FROM parts WHERE split = 'tune')
SELECT * FROM {outcome_sql(decided_sql('tune', 'w1 * part_score + w2 * part_frequency + w3 * part_size', 'th', 'tw', 'fr', 'pop.*, '), 'policy_id')}""")
def policy_population_sweep(spark, folder):
    return retention.sweep(tables(spark, folder).where("split = 'tune'"), POPULATION)


@query(f"""{WITH}, hold AS (SELECT * FROM parts WHERE split = 'holdout'), w AS (SELECT * FROM {one_policy('hold')})
SELECT count(*) FILTER (tier = 'WARM') AS warm_blocks, count(*) FILTER (tier = 'WARM' AND is_anomaly) AS warm_anomalies, count(*) FILTER (tier = 'WARM') / count(*) AS warm_block_share,
  avg(kept) FILTER (tier = 'WARM') AS mean_lines_per_warm_block, avg(lines) FILTER (tier = 'WARM') AS mean_event_frequency,
  avg(summary) FILTER (tier = 'WARM') AS mean_summary_lines, avg(CASE WHEN summary = 0 THEN 1.0 ELSE 0.0 END) FILTER (tier = 'WARM') AS share_kept_at_one_line,
  avg(summary / lines) FILTER (tier = 'WARM') AS mean_share_of_block_kept, avg(credit) FILTER (tier = 'WARM' AND is_anomaly) AS mean_credit_per_warm_anomaly FROM w""")
def warm_tier_diagnostics(spark, folder):
    return retention.warm_diagnostics(retention.decide(holdout(spark, folder), POLICY))


OVERRIDES = {"t_hot": 0.5, "weight_block_size": 0.4, "summary_fraction": 0.1}


@query(f"""{WITH}, hold AS (SELECT * FROM parts WHERE split = 'holdout') SELECT * FROM {outcome_sql(one_policy('hold', POLICY.with_overrides(OVERRIDES), 0.8, 0.5), '', 0.8)}""")
def what_if_simulation(spark, folder):
    return retention.simulate(holdout(spark, folder), POLICY, OVERRIDES, 0.8, 0.8, 0.5)


ORDERED = "(SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, block_id) AS rank, count(*) OVER () AS n FROM parts WHERE split = 'holdout')"
KEEP = "CASE WHEN {keep} THEN 'HOT' ELSE 'COLD' END AS tier, CASE WHEN {keep} THEN lines ELSE 1 END AS kept, CASE WHEN {keep} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS credit"


def kept_sql(source: str, keep: str, extra: str = "") -> str:
    return f"(SELECT {extra}{KEEP.replace('{keep}', keep)}, lines, is_anomaly, is_flagged FROM {source})"


PERCENTS = ", ".join(f"({d(float(p))})" for p in baselines.SWEEP_PERCENTS)


@query(f"""{WITH}, o AS {ORDERED}, ks(k_percent) AS (VALUES {PERCENTS})
SELECT * FROM {outcome_sql(kept_sql('o, ks', 'rank <= ceil(k_percent / 100.0 * n)', 'k_percent, '), 'k_percent')}""")
def top_k_percent_sweep(spark, folder):
    return baselines.top_k_percent(baselines.score_order(holdout(spark, folder)))


@query(f"""{WITH}, o AS {ORDERED}, r AS (SELECT rank, n, sum(CAST(is_anomaly AS INT)) OVER (ORDER BY rank) / sum(CAST(is_anomaly AS INT)) OVER () AS found FROM o)
SELECT 100.0 * min(rank) / max(n) AS k_percent, max(n) AS blocks FROM r WHERE found >= 0.95""")
def smallest_top_k_for_target(spark, folder):
    ordered = baselines.score_order(holdout(spark, folder))
    k = baselines.smallest_top_k_for_target(ordered)
    return ordered.agg(F.lit(k).alias("k_percent"), F.count("*").alias("blocks"))


COSTS = "(SELECT rank, n + sum(lines - 1) OVER (ORDER BY rank) AS cost FROM o UNION ALL SELECT 0, max(n) FROM o)"


@query(f"""{WITH}, o AS {ORDERED}, hold AS (SELECT * FROM parts WHERE split = 'holdout'), budget AS (SELECT kept_lines AS b FROM {outcome_sql(one_policy('hold'))}),
  cut AS (SELECT arg_min(rank, [abs(cost - b), CASE WHEN cost < b THEN 0 ELSE 1 END, CASE WHEN cost < b THEN -rank ELSE rank END]) AS c FROM {COSTS}, budget)
SELECT * FROM {outcome_sql(kept_sql('o, cut', 'rank <= c'))}""")
def top_k_at_equal_lines(spark, folder):
    table = written(holdout(spark, folder), "holdout")
    budget = retention.evaluate_policy(table, POLICY).first()["kept_lines"]
    return baselines.top_k_matching_lines(baselines.score_order(table), budget)


TRIALS = 5
BUDGET = outcome_sql(one_policy('hold'))


@query(f"""{WITH}, hold AS (SELECT * FROM parts WHERE split = 'holdout'), budget AS (SELECT kept_lines AS b FROM {BUDGET}),
  o AS (SELECT hold.*, trial, row_number() OVER (PARTITION BY trial ORDER BY md5('0:' || trial || ':' || block_id), block_id) AS rank, count(*) OVER (PARTITION BY trial) AS n
    FROM hold, (SELECT CAST(unnest(range({TRIALS})) AS INTEGER) AS trial)),
  costs AS (SELECT trial, rank, n + sum(lines - 1) OVER (PARTITION BY trial ORDER BY rank) AS cost FROM o UNION ALL SELECT trial, 0, max(n) FROM o GROUP BY trial),
  cut AS (SELECT trial, arg_min(rank, [abs(cost - b), CASE WHEN cost < b THEN 0 ELSE 1 END, CASE WHEN cost < b THEN -rank ELSE rank END]) AS c FROM costs, budget GROUP BY trial)
SELECT * FROM {outcome_sql(kept_sql('o JOIN cut USING (trial)', 'rank <= c', 'trial, '), 'trial')}""")
def random_blocks_at_equal_lines(spark, folder):
    table = written(holdout(spark, folder), "holdout")
    budget = retention.evaluate_policy(table, POLICY).first()["kept_lines"]
    return baselines.random_matching_lines(table, budget, TRIALS)


SHOWN = "storage_saved_pct, weighted_retention, full_retention, coverage, flagged_retention, fitness, meets_target"


@query(f"""{WITH}, hold AS (SELECT * FROM parts WHERE split = 'holdout'), ga AS (SELECT fitness AS g, kept_lines AS b FROM {BUDGET}), o AS {ORDERED},
  tuned AS (SELECT min(rank) / max(n) AS share FROM (SELECT rank, n, sum(CAST(is_anomaly AS INT)) OVER (ORDER BY rank) / sum(CAST(is_anomaly AS INT)) OVER () AS found
    FROM {ORDERED.replace("'holdout'", "'tune'")}) WHERE found >= 0.95),
  cut AS (SELECT arg_min(rank, [abs(cost - b), CASE WHEN cost < b THEN 0 ELSE 1 END, CASE WHEN cost < b THEN -rank ELSE rank END]) AS c FROM {COSTS}, ga),
  ro AS (SELECT hold.*, trial, row_number() OVER (PARTITION BY trial ORDER BY md5('0:' || trial || ':' || block_id), block_id) AS rank, count(*) OVER (PARTITION BY trial) AS n
    FROM hold, (SELECT unnest(range({TRIALS})) AS trial)),
  rcosts AS (SELECT trial, rank, n + sum(lines - 1) OVER (PARTITION BY trial ORDER BY rank) AS cost FROM ro UNION ALL SELECT trial, 0, max(n) FROM ro GROUP BY trial),
  rcut AS (SELECT trial, arg_min(rank, [abs(cost - b), CASE WHEN cost < b THEN 0 ELSE 1 END, CASE WHEN cost < b THEN -rank ELSE rank END]) AS c FROM rcosts, ga GROUP BY trial),
  rnd AS (SELECT avg(storage_saved_pct) AS s, avg(weighted_retention) AS w, avg(full_retention) AS f, avg(coverage) AS c, avg(flagged_retention) AS fl
    FROM {outcome_sql(kept_sql('ro JOIN rcut USING (trial)', 'rank <= c', 'trial, '), 'trial')}),
  u AS (SELECT 'keep_all' AS baseline, {SHOWN} FROM {outcome_sql(kept_sql('hold', 'TRUE'))}
    UNION ALL SELECT 'keep_flagged_only', {SHOWN} FROM {outcome_sql(kept_sql('hold', 'is_flagged'))}
    UNION ALL SELECT 'top_k_percent_tuned', {SHOWN} FROM {outcome_sql(kept_sql('o, tuned', 'rank <= ceil(share * 100.0 / 100.0 * n)'))}
    UNION ALL SELECT 'top_k_percent_same_savings', {SHOWN} FROM {outcome_sql(kept_sql('o, cut', 'rank <= c'))}
    UNION ALL SELECT 'random_sampling_same_savings', s, w, f, c, fl, s - 1000.0 * greatest(0, 0.95 - w), w >= 0.95 FROM rnd)
SELECT u.*, g > fitness AS policy_better FROM u, ga""")
def baseline_comparison(spark, folder):
    table = written(tables(spark, folder), "parts")
    hold, tune = table.where("split = 'holdout'"), table.where("split = 'tune'")
    return baselines.compare(tune, hold, retention.evaluate_policy(hold, POLICY), TRIALS)
