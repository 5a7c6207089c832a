"""Block labels: rules over audit events, label files, analyst verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loggrove.functions.stats import count_if
from loggrove.operators.vocab import lookup
from loggrove.schema import ANOMALY, NORMAL
from loggrove.scratch import written

# --- fixed values: weak rules over audit events -----------------------------
AUTH_ERROR = r"(?i)accessdenied|unauthorized"
AUTH_ERROR_BURST = 10
ERROR_CODE = r"errorCode=(\S+)"
IDENTITY_SERVICE = "iam.amazonaws.com"
SENSITIVE_PREFIXES = ("Create", "Delete", "Attach", "Detach", "Put", "Update", "Add", "Remove", "Upload", "Set", "Change")
STORAGE_SERVICE = "s3.amazonaws.com"
SENSITIVE_STORAGE_ACTIONS = (
    "PutBucketPolicy", "DeleteBucketPolicy", "PutBucketAcl", "PutObjectAcl", "DeleteBucket",
    "PutBucketPublicAccessBlock", "DeletePublicAccessBlock", "PutBucketCors", "PutBucketWebsite",
    "DeleteBucketWebsite", "PutBucketLogging", "PutBucketVersioning", "PutEncryptionConfiguration",
)
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def is_sensitive(component: Column, action: Column) -> Column:
    """A permission or policy change: by action prefix or by action name."""
    return F.coalesce(
        ((component == IDENTITY_SERVICE) & action.rlike("^(?:" + "|".join(SENSITIVE_PREFIXES) + ")"))
        | ((component == STORAGE_SERVICE) & action.isin(*SENSITIVE_STORAGE_ACTIONS)),
        F.lit(False))


def auth_error(raw_message: Column) -> Column:
    return F.regexp_extract(raw_message, ERROR_CODE, 1).rlike(AUTH_ERROR)


def block_hour(block_id: Column) -> Column:
    """The hour text after the last bar of an identity-hour block id."""
    return F.substring_index(block_id, "|", -1)


def weak_labels(log: DataFrame, auth: Column | None = None, sensitive: Column | None = None,
                burst: int = AUTH_ERROR_BURST) -> DataFrame:
    """Label identity-hour blocks by two rules.

    R1: at least ``burst`` authorization errors. R2: a sensitive action from an
    address first seen anywhere in the trace during the block's own hour. The first
    hour per address is an aggregate; rows are reduced to one per (block, address)
    before the two meet, so a busy address or block does not travel row by row.
    """
    rows = log.select(
        "block_id", F.col("source_ip"), F.col("datetime"), block_hour(F.col("block_id")).alias("hour"),
        (auth if auth is not None else auth_error(F.col("raw_message"))).alias("auth"),
        (sensitive if sensitive is not None else is_sensitive(F.col("component"), F.col("event_type"))).alias("sensitive"),
    )
    per_pair = written(rows.groupBy("block_id", "hour", "source_ip").agg(
        count_if(F.col("auth")).alias("auth_errors"), count_if(F.col("sensitive")).alias("sensitive_actions"),
        F.min("datetime").alias("first_time")), "pairs")
    first_hour = per_pair.groupBy("source_ip").agg(F.min_by("hour", F.struct("first_time", "hour")).alias("first_hour"))
    first_hour = written(first_hour, "addresses")
    candidates = lookup(per_pair.where(F.col("sensitive_actions") > 0), first_hour, ["source_ip"])
    fresh = candidates.where(F.col("hour") == F.col("first_hour")).groupBy("block_id").agg(
        F.sum("sensitive_actions").alias("new_address_actions"))
    blocks = per_pair.groupBy("block_id").agg(F.sum("auth_errors").alias("auth_errors"))
    joined = blocks.join(fresh, "block_id", "left")
    r1 = F.col("auth_errors") >= burst
    r2 = F.coalesce(F.col("new_address_actions"), F.lit(0)) > 0
    return joined.select(
        "block_id", F.when(r1 | r2, ANOMALY).otherwise(NORMAL).alias("label"),
        r1.alias("rule_auth_error_burst"), r2.alias("rule_new_address_sensitive"), "auth_errors",
        F.coalesce("new_address_actions", F.lit(0)).alias("new_address_actions"))


def rule_counts(labels: DataFrame) -> DataFrame:
    r1, r2 = F.col("rule_auth_error_burst"), F.col("rule_new_address_sensitive")
    return labels.agg(
        F.count(F.lit(1)).alias("blocks"), count_if(r1).alias("auth_error_burst"),
        count_if(r2).alias("new_address_sensitive"), count_if(r1 & r2).alias("both"),
        count_if(F.col("label") == ANOMALY).alias("anomalies"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, label) from a CSV headed ``BlockId,Label`` or ``block_id,label[,…]``."""
    table = spark.read.option("header", True).csv(path)
    names = {c.lower().replace("_", ""): c for c in table.columns}
    if "blockid" not in names or "label" not in names:
        raise ValueError(f"no block id and label columns in {table.columns}")
    return table.select(F.col(names["blockid"]).alias("block_id"), F.col(names["label"]).alias("label"))


def ids_in_text(lines: DataFrame, pattern: str = UUID, column: str = "value") -> DataFrame:
    """Distinct ids mentioned anywhere in free text."""
    found = F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1))
    return lines.select(F.explode(found).alias("block_id")).distinct()


def sessions_in_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct instance ids of the lines of one file."""
    found = F.regexp_extract_all(F.col(column), F.lit(rf"\[instance:\s*({UUID})\]"), F.lit(1))
    return lines.select(F.explode(found).alias("block_id")).distinct()


def membership_labels(blocks: DataFrame, abnormal: DataFrame) -> DataFrame:
    """Anomaly iff the block occurs among the abnormal ids."""
    marked = abnormal.select("block_id").distinct().withColumn("_hit", F.lit(True))
    return blocks.join(marked, "block_id", "left").withColumn(
        "label", F.when(F.col("_hit"), ANOMALY).otherwise(NORMAL)).drop("_hit")


def attach_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Every block with its label; blocks the table lacks count as Normal and are marked."""
    return blocks.join(labels.select("block_id", "label"), "block_id", "left").withColumn(
        "label_missing", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit(NORMAL)))


def labeled_only(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks that have a label (inner join on the block id)."""
    return blocks.join(labels.select("block_id", "label"), "block_id")


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """The newest verdict per (source, block)."""
    newest = F.struct("at", "verdict")
    return feedback.groupBy("source", "block_id").agg(F.max(newest).alias("_v")).select(
        "source", "block_id", F.initcap("_v.verdict").alias("verdict"), F.col("_v.at").alias("at"))


def apply_feedback(labeled: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts replace labels; ``verdict`` stays for the counts."""
    return labeled.join(verdicts.select("block_id", "verdict"), "block_id", "left").withColumn(
        "previous_label", F.col("label")).withColumn("label", F.coalesce("verdict", "label"))


def feedback_counts(labeled: DataFrame, verdicts: DataFrame) -> DataFrame:
    """applied, changed, confirmed, marked normal, and verdicts for unknown blocks."""
    joined = labeled.select("block_id", "label").join(verdicts.select("block_id", "verdict"), "block_id", "full")
    applied = F.col("verdict").isNotNull() & F.col("label").isNotNull()
    return joined.agg(
        count_if(applied).alias("applied"),
        count_if(applied & (F.col("verdict") != F.col("label"))).alias("changed"),
        count_if(applied & (F.col("verdict") == ANOMALY)).alias("confirmed_anomalies"),
        count_if(applied & (F.col("verdict") == NORMAL)).alias("marked_normal"),
        count_if(F.col("verdict").isNotNull() & F.col("label").isNull()).alias("outside_dataset"))


def faulty_check(blocks: DataFrame, faulty: DataFrame) -> DataFrame:
    """How many of the known-faulty ids are present, and how many of those are flagged.
    ``blocks`` has block_id and predicted_label."""
    marked = blocks.join(faulty.select("block_id").distinct().withColumn("_faulty", F.lit(True)), "block_id", "left")
    flagged, is_faulty = F.col("predicted_label") == ANOMALY, F.coalesce(F.col("_faulty"), F.lit(False))
    return marked.agg(
        count_if(is_faulty).alias("faulty_present"), count_if(is_faulty & flagged).alias("faulty_caught"),
        count_if(flagged).alias("flagged_overall"))
