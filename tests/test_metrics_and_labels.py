import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loggrove.operators import audit, labels, metrics
from loggrove.plans import uploads, views

T0 = dt.datetime(2019, 8, 21, 11, 0, 0)
AUDIT = "datetime timestamp_ntz, block_id string, component string, event_type string, source_ip string, raw_message string"


def audit_rows(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m), f"{who}|{(T0 + dt.timedelta(minutes=m)):%Y%m%dT%H}", c, e, ip, f"eventID=x errorCode={code}")
                                  for m, who, c, e, ip, code in rows], AUDIT)


def test_auth_burst_needs_ten(spark):
    rows = [(0, "a", "ec2", "Run", "1.1.1.1", "Client.UnauthorizedOperation")] * 10 + [(0, "b", "ec2", "Run", "1.1.1.1", "AccessDenied")] * 9
    out = {r["block_id"]: r["label"] for r in labels.weak_labels(audit_rows(spark, rows)).collect()}
    assert out == {"a|20190821T11": "Anomaly", "b|20190821T11": "Normal"}


def test_sensitive_call_from_a_new_address(spark):
    rows = [(5, "a", "iam.amazonaws.com", "CreateUser", "9.9.9.9", "-"), (70, "b", "iam.amazonaws.com", "CreateUser", "9.9.9.9", "-"),
            (6, "c", "iam.amazonaws.com", "ListUsers", "8.8.8.8", "-"), (7, "d", "s3.amazonaws.com", "PutBucketPolicy", "7.7.7.7", "-")]
    found = labels.weak_labels(audit_rows(spark, rows))
    out = {r["block_id"][0]: r["label"] for r in found.collect()}
    assert out == {"a": "Anomaly", "b": "Normal", "c": "Normal", "d": "Anomaly"}
    assert labels.rule_counts(found).first().asDict() == {"blocks": 4, "auth_error_burst": 0, "new_address_sensitive": 2, "both": 0, "anomalies": 2}


def test_sensitive_actions(spark):
    frame = spark.createDataFrame([("iam.amazonaws.com", "DetachRolePolicy"), ("iam.amazonaws.com", "GetUser"), ("s3.amazonaws.com", "PutObject"),
                                   ("s3.amazonaws.com", "DeleteBucket"), ("ec2.amazonaws.com", "CreateVpc"), (None, None)], "c string, e string")
    assert [r[0] for r in frame.select(labels.is_sensitive(F.col("c"), F.col("e"))).collect()] == [True, False, False, True, False, False]


def test_feedback(spark):
    labeled = spark.createDataFrame([("a", "Normal"), ("b", "Anomaly"), ("c", "Normal")], "block_id string, label string")
    at = [T0 + dt.timedelta(minutes=i) for i in range(5)]
    feedback = spark.createDataFrame([("s", "a", "normal", at[0]), ("s", "a", "anomaly", at[1]), ("s", "b", "anomaly", at[2]), ("s", "z", "normal", at[3])],
                                     "source string, block_id string, verdict string, at timestamp_ntz")
    verdicts = labels.latest_verdicts(feedback)
    assert labels.feedback_counts(labeled, verdicts).first().asDict() == {
        "applied": 2, "changed": 1, "confirmed_anomalies": 2, "marked_normal": 0, "outside_dataset": 1}
    assert {r["block_id"]: r["label"] for r in labels.apply_feedback(labeled, verdicts).collect()} == {"a": "Anomaly", "b": "Anomaly", "c": "Normal"}


def test_label_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Anomaly\n")
    assert labels.read_labels(spark, str(tmp_path / "l.csv")).first().asDict() == {"block_id": "blk_1", "label": "Anomaly"}
    uuid = "544fd51c-4edc-4780-baae-ba1d80a0acfc"
    lines = spark.createDataFrame([(f"The anomalous instances: {uuid}\r",), (f"x [instance: {uuid}] y",)], "value string")
    assert [r[0] for r in labels.ids_in_text(lines).collect()] == [uuid]
    assert [r[0] for r in labels.sessions_in_text(lines).collect()] == [uuid]
    blocks = spark.createDataFrame([(uuid,), ("other",)], "block_id string")
    assert {r["block_id"]: r["label"] for r in labels.membership_labels(blocks, labels.ids_in_text(lines)).collect()} == {uuid: "Anomaly", "other": "Normal"}
    attached = labels.attach_labels(blocks, spark.createDataFrame([(uuid, "Anomaly")], "block_id string, label string"))
    assert {r["block_id"]: (r["label"], r["label_missing"]) for r in attached.collect()} == {uuid: ("Anomaly", False), "other": ("Normal", True)}


def labeled(spark, pairs):
    return spark.createDataFrame([(f"b{i}", t, p) for i, (t, p) in enumerate(pairs)], "block_id string, true_label string, predicted_label string")


def test_evaluation_and_empty_denominators(spark):
    row = metrics.evaluate(labeled(spark, [("Anomaly", "Anomaly"), ("Anomaly", "Normal"), ("Normal", "Anomaly"), ("Normal", "Normal")])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["false_positive_rate"]) == (0.5, 0.5, 0.5, 0.5, 0.5)
    row = metrics.evaluate(labeled(spark, [("Normal", "Normal")])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def brute_auc(scores, positive):
    pos, neg = scores[positive], scores[~positive]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    positive = rng.random(400) < 0.2
    score = np.round(rng.normal(size=400) + positive, 1)
    rows = [(f"b{i}", float(s), float(-s), 3.0, "Anomaly" if p else "Normal", "k" if i % 2 else "j") for i, (s, p) in enumerate(zip(score, positive))]
    frame = spark.createDataFrame(rows, "block_id string, score double, minus double, flat double, label string, part string").persist()
    return frame, score, positive


def test_auc_and_separability(spread, points):
    frame, score, positive = points
    y = F.col("label") == "Anomaly"
    area = metrics.roc_auc(frame, ["score"], y).first()["auc"]
    assert area == pytest.approx(brute_auc(score, positive))
    out = {r["feature"]: r["separability"] for r in metrics.separability(frame, ["score", "minus", "flat"], y).collect()}
    assert out["score"] == out["minus"] == round(area, 4) and out["flat"] == 0.5


def test_tuned_threshold_is_the_best_allowed_cut(spread, points):
    frame, score, positive = points
    y = F.col("label") == "Anomaly"

    def best(s, p):
        low, high = np.quantile(s, [0.5, 0.9995])
        options = [c for c in np.unique(s) if low <= c <= high] + [high]
        value = lambda c: 2 * (p & (s >= c)).sum() / ((s >= c).sum() + p.sum())
        return max(value(c) for c in options), value

    top, value = best(score, positive)
    row = metrics.tune_threshold(frame, "score", y).first()
    assert row["train_f1"] == pytest.approx(top) and value(row["threshold"]) == pytest.approx(top)
    by_part = {r["part"]: r["train_f1"] for r in metrics.tune_threshold(frame, "score", y, by=["part"]).collect()}
    odd = np.arange(400) % 2 == 1
    assert by_part["k"] == pytest.approx(best(score[odd], positive[odd])[0]) and by_part["j"] == pytest.approx(best(score[~odd], positive[~odd])[0])


def test_strict_and_inclusive_cuts(spark):
    frame = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "block_id string, score double")
    out = {r["block_id"]: (r["predicted_label"], round(r["anomaly_score"], 6)) for r in metrics.predict_at(frame, 0.5).collect()}
    assert out == {"a": ("Normal", 0.0), "b": ("Anomaly", 0.1)}


def test_severity_tertiles(spark):
    rows = [(f"b{i}", float(i), "Anomaly" if i >= 4 else "Normal") for i in range(10)]
    frame = spark.createDataFrame(rows, "block_id string, anomaly_score double, predicted_label string")
    cuts = np.quantile(np.arange(4, 10), [1 / 3, 2 / 3])
    out = {r["block_id"]: r["severity"] for r in metrics.with_severity(frame).collect()}
    for i in range(10):
        assert out[f"b{i}"] == ("normal" if i < 4 else "critical" if i >= cuts[1] else "high" if i >= cuts[0] else "medium")
    assert metrics.with_severity(frame.where("predicted_label = 'Normal'")).select("severity").distinct().first()[0] == "normal"


def test_alert_metrics(spark):
    rows = [("a", True, True, 0.5, 10), ("b", True, True, 0.0, 0), ("c", True, False, 0.9, 5), ("d", False, True, 0.2, 7), ("e", False, False, 0.1, 1)]
    frame = spark.createDataFrame(rows, "block_id string, alert boolean, is_anomaly boolean, lead double, lead_seconds long")
    row = metrics.alert_metrics(frame).first()
    assert (row["precision"], row["recall"], row["alerts"], row["mean_lead"], row["median_lead"], row["share_before_end"]) == (
        pytest.approx(2 / 3), pytest.approx(2 / 3), 3, 0.25, 0.25, 0.5)
    assert row["expected_lead_per_alert"] == pytest.approx(0.5 / 3) and row["median_lead_seconds"] == 5.0
    silent = metrics.alert_metrics(frame.withColumn("alert", F.lit(False))).first()
    assert (silent["precision"], silent["mean_lead"], silent["median_lead_seconds"]) == (0.0, 0.0, None)


@pytest.mark.parametrize("seed", range(4))
def test_pareto_front_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data = [(int(k), float(p), float(m), float(p * m)) for k, (p, m) in enumerate(rng.integers(0, 4, (8, 2)) / 4)]
    out = {r["k"]: r for r in metrics.pareto_front(spark.createDataFrame(data, "k int, p double, m double, e double"), "k", "p", "m", "e").collect()}
    for k, p, m, _ in data:
        beaten = any(q >= p and n >= m and (q > p or n > m) for j, q, n, _ in data if j != k)
        assert out[k]["on_pareto_front"] == (not beaten)
    front = [r for r in data if out[r[0]]["on_pareto_front"]]
    best = [k for k in out if out[k]["is_best"]]
    assert len(best) == 1 and max(r[3] for r in front) == data[best[0]][3]


def test_readiness(spark):
    features = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("b", 3, 5)], "block_id string, x int, same int")
    keys = spark.createDataFrame([("a", "Normal"), ("b", "Anomaly")], "block_id string, label string")
    report = audit.readiness(features, keys)
    flagged = {r["check"] for r in report.where("flagged").collect()}
    assert flagged == {"duplicate_feature_ids", "constant:same"} and not audit.is_ready(report)
    assert audit.is_ready(audit.readiness(features.where("x < 3").drop("same"), keys))
    assert audit.find_column(features, audit.BLOCK_ID_NAMES) == "block_id"
    assert audit.find_column(spark.createDataFrame([("blk_1", 3)], "u string, v int"), ("id",), r"^blk_") == "u"
    with pytest.raises(ValueError, match="row count"):
        audit.join_without_loss(features, keys.where("block_id = 'a'"), "block_id")


def test_views(spark):
    base = "block_id string, first_seen timestamp_ntz, component string, event_type string, source_ip string, anomaly_score double, predicted_label string"
    dataset = spark.createDataFrame([("a", T0, "Comp.One", "e", "1.1.1.1", 0.9, "Anomaly"), ("b", T0, "c2", "e", "1.1.1.2", 0.1, "Normal")], base)
    extra = spark.createDataFrame([("a", T0, "x", "e", "i", 0.5, "Anomaly", "u1", T0), ("n", T0, "x", "e", "i", 0.7, "Anomaly", "u1", T0),
                                   ("n", T0, "y", "e", "i", 0.6, "Anomaly", "u2", T0 + dt.timedelta(days=1))],
                                  base + ", upload_id string, uploaded_at timestamp_ntz").withColumn("event_frequency", F.lit(3).cast("long"))
    view = views.current_predictions(dataset.drop("component"), dataset.select("block_id", "component"), extra)
    rows = {r["block_id"]: r for r in view.collect()}
    assert set(rows) == {"a", "b", "n"} and rows["n"]["component"] == "x" and rows["n"]["origin"] == "upload" and rows["a"]["severity"] == "critical"
    assert [r["block_id"] for r in views.filter_detections(view, search="comp.one").collect()] == ["a"]
    assert views.filter_detections(view, search="compXone").count() == 0
    assert [r["block_id"] for r in views.detections_page(view, 2, 2).collect()] == ["b"]
    counts = uploads.result_counts(view).first()
    assert (counts["blocks_analyzed"], counts["anomalies_detected"], counts["anomaly_rate_pct"]) == (3, 2, 66.67)
    with pytest.raises(ValueError, match="labels"):
        uploads.verify_blind(view.withColumn("label", F.lit("x")), dataset)


def test_many_cuts_in_one_pass_agree_with_plain_counts(spark):
    scores = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.25, 0.25, 0.5, 0.75, 1.0]
    frame = spark.createDataFrame([(s, i % 3 == 0) for i, s in enumerate(scores)], "score double, yes boolean")
    cuts = [("a", 0.25), ("b", 0.0), ("same", 0.25), ("c", 0.6), ("top", 2.0), ("low", -1.0)]
    found = {r["name"]: (r["tp"], r["flagged"], r["positives"]) for r in metrics.metrics_at(frame, "score", F.col("yes"), cuts).collect()}
    for name, cut in cuts:
        over = F.col("score") > cut
        plain = frame.agg(F.count_if(over & F.col("yes")), F.count_if(over), F.count_if("yes")).first()
        assert found[name] == tuple(plain), name
    assert metrics.metrics_at(frame.limit(0), "score", F.col("yes"), cuts).count() == 0


def test_event_types_beyond_the_named_ones_share_columns(spark):
    from loggrove.operators.prefix import count_columns, model_columns

    types = {f"type-{i}": i + 1 for i in range(5_000)}
    frame = spark.createDataFrame([("x", types), ("y", {"type-3": 2}), ("z", {}), ("n", None)], "block_id string, type_counts map<string,int>")
    named = ["type-0", "type-3"]
    rows = {r["block_id"]: r.asDict() for r in count_columns(frame, named, 8).collect()}
    total = lambda row: sum(row[c] for c in model_columns(named, 8) if "count_" in c and c in row and c not in ("warn_count", "error_count"))
    assert total(rows["x"]) == sum(types.values()) and rows["x"]["count_type-3"] == 4
    assert (rows["y"]["count_type-3"], total(rows["y"])) == (2, 2) and total(rows["z"]) == 0
    assert min(rows["x"][f"shared_count_{i}"] for i in range(8)) > 0
    assert "shared_count_0" not in count_columns(frame, named).columns
