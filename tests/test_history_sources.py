"""History views, evidence, sources and the streaming monitor."""
import datetime as dt

from pyspark.sql import functions as F

from modelwatch.operators import evidence as EV
from modelwatch.operators import history as H
from modelwatch.sources import files as S


def test_history_last_n_uses_group_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", t0 + dt.timedelta(minutes=i), i, "FAIL" if i % 3 == 0 else "PASS")
                                for i in range(500)], "model string, ts timestamp_ntz, event_id long, status string")
    last = H.history_last_n(df, 200)
    assert last.count() == 200 and last.agg(F.min("event_id")).first()[0] == 300
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    f = H.fail_count_recent(df, 100).first()
    assert (f["n_recent"], f["n_fail"]) == (100, len([i for i in range(400, 500) if i % 3 == 0]))


def test_fingerprint_is_layout_independent(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    a = EV.table_fingerprint(df).first()
    b = EV.table_fingerprint(df.repartition(17).orderBy(F.rand(1))).first()
    assert a == b and a["rows"] == 1000


def test_file_digest_and_checklist(spark, tmp_path):
    import hashlib
    p = tmp_path / "x.json"
    p.write_bytes(b'{"a": 1}')
    d = EV.file_digest(spark, str(p)).first()
    assert d["sha256"] == hashlib.sha256(b'{"a": 1}').hexdigest() and d["size_bytes"] == 8
    exp = spark.createDataFrame([("x.json",), ("y.json",)], "name string")
    got = {r["name"]: r["present"] for r in EV.checklist_join(exp, EV.file_digest(spark, str(p))).collect()}
    assert got == {"x.json": True, "y.json": False}


def test_file_digest_lists_absent_files(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b"{}")
    found = EV.file_digest(spark, [str(tmp_path / "x.json"), str(tmp_path / "y.json")])
    got = {r["name"]: (r["exists"], r["size_bytes"]) for r in found.collect()}
    assert got == {"x.json": (True, 2), "y.json": (False, None)}
    exp = spark.createDataFrame([("x.json",), ("y.json",)], "name string")
    assert {r["name"]: r["present"] for r in EV.checklist_join(exp, found).collect()} == {"x.json": True, "y.json": False}
    assert EV.file_digest(spark, str(tmp_path / "z.json")).first()["exists"] is False


def test_content_digest_of_text(spark):
    import hashlib
    df = spark.createDataFrame([("a", "h\u00e9"), ("b", ""), ("c", None)], "name string, text string")
    got = {r["name"]: (r["size_bytes"], r["sha256"]) for r in EV.content_digest(df, "text").collect()}
    assert got["a"] == (3, hashlib.sha256("h\u00e9".encode()).hexdigest())
    assert got["b"] == (0, hashlib.sha256(b"").hexdigest()) and got["c"] == (None, None)


def test_scan_predictions_drops_bad_rows(spark, tmp_path):
    p = tmp_path / "preds.csv"
    p.write_text("﻿y_true,y_pred_prob\n1,0.91\n0,0.12\nx,0.5\n1,abc\n1.0,0.3\n0,0.05\n", encoding="utf-8")
    df = S.scan_predictions(spark, str(p))
    assert sorted(tuple(r) for r in df.collect()) == [(0, 0.05), (0, 0.12), (1, 0.91)]


def test_scan_csv_any_prefers_gzip(spark, tmp_path):
    base = str(tmp_path / "t.csv")
    spark.createDataFrame([(1,)], "a int").write.option("header", True).csv(base)
    assert S.scan_csv_any(spark, base, schema="a int").count() == 1
    spark.createDataFrame([(1,), (2,)], "a int").write.option("header", True).option("compression", "gzip").csv(base + ".gz")
    assert S.scan_csv_any(spark, base, schema="a int").count() == 2


def test_stream_monitor_resumes_without_duplicates(spark, tmp_path):
    from modelwatch.streaming.monitor import monitor_stream
    src, hist, ck = str(tmp_path / "src"), str(tmp_path / "hist"), str(tmp_path / "ck")
    schema = "y_true int, y_score double"

    def drop_file(i):
        spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.6 + i / 100), (0, 0.4)], schema) \
             .coalesce(1).write.mode("append").parquet(src)

    for i in range(2):
        drop_file(i)
    monitor_stream(spark, src, schema, hist, files_per_batch=1, checkpoint=ck).awaitTermination()
    first = spark.read.parquet(hist)
    assert sorted(r["batch_id"] for r in first.collect()) == [0, 1]
    assert all(r["status"] == "PASS" and r["n"] == 4 for r in first.collect())
    drop_file(2)                                    # restart: only the new file is processed
    monitor_stream(spark, src, schema, hist, files_per_batch=1, checkpoint=ck).awaitTermination()
    assert sorted(r["batch_id"] for r in spark.read.parquet(hist).collect()) == [0, 1, 2]


def test_scan_json_report_counts_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_id": "r1", "auroc": 0.8}')
    (tmp_path / "b.json").write_text('{"run_id": "r2", "auroc": ')
    df = S.scan_json_report(spark, str(tmp_path), "run_id string, auroc double")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in df.collect()}
    assert rows["a.json"]["auroc"] == 0.8 and rows["a.json"]["_corrupt"] is None
    assert rows["b.json"]["run_id"] is None and rows["b.json"]["_corrupt"] is not None


def test_scan_run_log_tracking_layout(spark, tmp_path):
    for run, metrics in {"runA": {"auroc": "1700000000 0.91 0", "ks_stat": "1700000000 0.4 0"},
                         "runB": {"auroc": "1700000100 0.55 1\n"}}.items():
        d = tmp_path / "0" / run / "metrics"
        d.mkdir(parents=True)
        for m, line in metrics.items():
            (d / m).write_text(line)
    df = S.scan_run_log(spark, str(tmp_path))
    got = sorted((r["run_id"], r["metric"], r["ts"], r["value"], r["step"]) for r in df.collect())
    assert got == [("runA", "auroc", 1700000000, 0.91, 0), ("runA", "ks_stat", 1700000000, 0.4, 0),
                   ("runB", "auroc", 1700000100, 0.55, 1)]
    assert [r["run_id"] for r in S.list_runs(df).collect()] == ["runA", "runB"]


def test_trust_audit_summary(spark):
    perf = spark.createDataFrame([("r1", 10, 0.3), ("r2", None, None)], "run_id string, n long, ks_stat double")
    gate = spark.createDataFrame([("r1", "pass")], "run_id string, status string")
    fails = spark.createDataFrame([("m1", 100, 3), ("m2", 40, 2)], "model string, n_recent long, n_fail long")
    top = spark.createDataFrame([(f"f{i}", float(i % 7), i) for i in range(40)],
                                "name string, mean_abs_impact double, pos int")
    out = {r["run_id"]: r for r in H.trust_audit_summary(perf, gate, fails, top).collect()}
    assert out["r1"]["entries_evaluated"] == 10 and out["r1"]["policy_status"] == "PASS"
    assert out["r2"]["entries_evaluated"] == 0 and out["r2"]["max_ks"] == 0.0 and out["r2"]["policy_status"] == "FAIL"
    assert out["r1"]["drift_flags"] == 5
    feats = out["r1"]["top_features"]
    assert len(feats) == 25 and feats[:2] == ["f13", "f20"]        # impact 6.0, ties by name
    own = spark.createDataFrame([("r1", 7)], "run_id string, n_fail long")
    out = {r["run_id"]: r["drift_flags"] for r in H.trust_audit_summary(perf, gate, own, top).collect()}
    assert out == {"r1": 7, "r2": 0}
