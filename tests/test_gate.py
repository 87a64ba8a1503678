"""Gates: the reference's validator and gate unit cases, checks with SKIP, audits."""
from pyspark.sql import functions as F

from modelwatch.operators import gate as G


def metrics(spark, rows):
    return spark.createDataFrame(rows, "run_id string, auroc double, ks_stat double")


def test_gate_required(spark):
    out = {r["run_id"]: r for r in G.gate_required(metrics(spark, [("ok", 0.9, 0.2), ("bad", 0.6, 0.05)])).collect()}
    assert out["ok"]["status"] == "PASS" and out["ok"]["reasons"] == []
    assert out["bad"]["status"] == "FAIL"
    assert any("AUROC" in r for r in out["bad"]["reasons"]) and any("KS" in r for r in out["bad"]["reasons"])


def test_gate_basic_null_rules(spark):
    out = {r["run_id"]: r for r in G.gate_basic(metrics(spark, [("a", 1.0, None), ("b", None, 0.5)])).collect()}
    assert out["a"]["status"] == "PASS" and out["a"]["max_ks"] is None
    assert out["b"]["status"] == "FAIL" and out["b"]["reasons"] == ["auroc<0.7"]
    fb = {r["run_id"]: r["status"] for r in G.gate_fallback(metrics(spark, [("a", 1.0, None)])).collect()}
    assert fb["a"] == "FAIL"


def test_gate_checks_skip_and_status(spark):
    obs = spark.createDataFrame([("r1", None, None, 1.0, 1.0, None, True, 3),
                                 ("r2", 0.5, 0.1, 1.0, 1.0, 0.2, True, 3)],
                                "run_id string, max_psi double, max_ks double, auroc double, auprc double, "
                                "parity_gap double, shap_artifact_present boolean, top_features_detected int")
    rows = G.gate_checks(obs).collect()
    r1 = {r["name"]: r["result"] for r in rows if r["run_id"] == "r1"}
    assert r1["drift.psi"] == "SKIP" and r1["performance.auroc"] == "PASS"
    st = {r["run_id"]: r["status"] for r in rows}
    assert st == {"r1": "PASS", "r2": "FAIL"}


def test_audit_and_normalize(spark):
    obs = spark.createDataFrame([("r", 0.6, 0.1, 0.3, 0.3, 0.1, False, 1)],
                                "run_id string, auroc double, auprc double, psi double, ks double, parity_gap double, "
                                "shap_artifact_present boolean, top_features_count int")
    v = G.audit_violations(obs).collect()[0]["violations"]
    assert "AUROC 0.600 < min_auroc 0.750" in v and "PSI 0.300 > psi_fail 0.200" in v
    assert "SHAP artifact required but missing" in v and "top_features_count 1 < required 2" in v
    res = G.audit_result(G.audit_violations(obs), strict=True).collect()[0]
    assert res["result"] == "FAIL"
    df = spark.createDataFrame([("Passed",), ("oops",), (None,)], "status string")
    assert [r[0] for r in df.select(G.gate_status_normalize(df)).collect()] == ["pass", "fail", "fail"]


def test_policy_file_thresholds_reach_checks(spark, tmp_path):
    p = tmp_path / "policy.yaml"
    p.write_text("drift:\n  psi_fail: 0.5\n  ks_fail: 0.05\nperformance:\n  min_auroc: 0.9\n  min_auprc: 0.1\n"
                 "fairness:\n  parity_gap_fail: 0.3\nexplainability:\n  top_features_min: 5\n"
                 "  require_shap_artifact: false\n")
    pol = G.load_policy(str(p))
    obs = spark.createDataFrame([("r", 0.3, 0.1, 0.85, 0.5, 0.2, False, 3)],
                                "run_id string, max_psi double, max_ks double, auroc double, auprc double, "
                                "parity_gap double, shap_artifact_present boolean, top_features_detected int")
    got = {r["name"]: (r["threshold"], r["result"]) for r in G.gate_checks(obs, pol).collect()}
    assert got["drift.psi"] == (0.5, "PASS") and got["drift.ks"] == (0.05, "FAIL")
    assert got["performance.auroc"] == (0.9, "FAIL") and got["fairness.parity_gap"] == (0.3, "PASS")
    assert got["explainability.shap_artifact_present"] == (0.0, "PASS")
    assert got["explainability.top_features_min"] == (5.0, "FAIL")
    assert G.policy_table(spark, pol).count() == 7


def test_threshold_table_and_risk(spark):
    m = spark.createDataFrame([("r1", 0.8, 0.05, 0.15), ("r2", None, 0.3, 0.05)],
                              "run_id string, auroc double, ks_stat double, max_psi double")
    t = {(r["run_id"], r["metric"]): r["status"] for r in G.threshold_table(m).collect()}
    assert t[("r1", "AUROC")] == "PASS" and t[("r1", "KS Statistic")] == "FAIL"
    assert t[("r1", "Max PSI")] == "WARN" and t[("r2", "AUROC")] == "—" and t[("r2", "Max PSI")] == "PASS"
    runs = spark.createDataFrame([("a", "PASS", 0.8, 0.2, 3, 5), ("b", "FAIL", 0.8, 0.2, 3, 5),
                                  ("c", "FAIL", None, 0.2, 0, 0)],
                                 "run_id string, gate_status string, auroc double, ks_stat double, "
                                 "n_fairness_slices int, n_top_features int")
    r = {x["run_id"]: (x["risk_score"], x["risk_level"]) for x in G.risk_score(runs).collect()}
    assert r == {"a": (0, "LOW"), "b": (2, "MEDIUM"), "c": (5, "HIGH")}


def test_gate_fails_closed_without_artifact(spark):
    from modelwatch.operators import gate as G
    good = "1 AS run_id, 0.0D AS max_psi, 0.0D AS max_ks, 0.9D AS auroc, 0.9D AS auprc, 0.0D AS parity_gap, 9 AS top_features_detected"
    for extra in ("", ", CAST(NULL AS BOOLEAN) AS shap_artifact_present"):
        r = G.gate_status(G.gate_checks(spark.sql(f"SELECT {good}{extra}"))).first()
        assert r["status"] == "FAIL"
    assert G.gate_status(G.gate_checks(spark.sql(f"SELECT {good}, true AS shap_artifact_present"))).first()["status"] == "PASS"


def test_small_ks_prints_plain_decimals(spark):
    from modelwatch.operators import gate as G
    r = G.gate_required(spark.sql("SELECT 1 AS run_id, 0.9D AS auroc, 0.00045D AS ks_stat")).first()
    assert r["reasons"] == ["KS 0.00045 < min_ks 0.1"]


def test_live_validation_without_gate_record(spark):
    perf = spark.createDataFrame([("r1", 4, 1.0, 1.0, 1.0), ("r2", 4, 1.0, 1.0, 1.0)],
                                 "run_id string, n long, accuracy_at_05 double, auroc double, ks_stat double")
    gate = G.gate_basic(perf.where("run_id = 'r1'"))
    out = {r["run_id"]: r for r in G.live_validation(perf, gate).collect()}
    assert out["r1"]["status"] == "PASS" and out["r1"]["gate"]["reasons"] == []
    assert out["r1"]["gate"]["policy"]["min_auroc"] == 0.7
    assert out["r2"]["status"] == "FAIL" and out["r2"]["gate"]["status"] == "fail"
    assert out["r2"]["gate"]["reasons"] == [G.NO_GATE] and out["r2"]["gate"]["policy"] is None
