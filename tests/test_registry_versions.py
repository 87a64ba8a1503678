"""Registry files, versions in time, runs judged by the version in force, rosters of runs."""
import datetime
import json

import pytest

from modelwatch.operators import gate as G
from modelwatch.operators import registry_versions as R

DAY = datetime.date
YAML = """
registry_version: 1
policies:
  - id: default
    file: a.yaml
    version: 1.0.0
    owner: "Some Owner"
    last_review: "2025-10-29"
    notes: "Baseline: PSI, KS."
    schema_version: 1
    active: true
  - just text
history:
  - id: default
    version: 0.9.0
    last_review: "2025-10-20"
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r1.yaml").write_text(YAML)
    (tmp_path / "r2.json").write_text(json.dumps({"policies": [{"id": "b", "version": 2, "file": "b.json", "last_review": "bad"}], "history": None}))
    (tmp_path / "r3.yaml").write_text("{ broken: [")
    (tmp_path / "r4.yaml").write_text("- a list")
    (tmp_path / "a.yaml").write_text("performance: {min_auroc: 0.6}\n")
    (tmp_path / "b.json").write_text(json.dumps({"performance": {"min_auroc": 0.9}}))
    return str(tmp_path)


def test_registry_files(spark, files):
    pytest.importorskip("yaml")
    rows = {(r.policy_id, r.version): r for r in R.registry_entries(spark, f"{files}/r*").collect()}
    assert set(rows) == {("default", "1.0.0"), ("default", "0.9.0"), ("b", "2")}
    a, old, b = rows["default", "1.0.0"], rows["default", "0.9.0"], rows["b", "2"]
    assert (a.owner, a.last_review, a.notes, a.schema_version, a.active, a.current) == ("Some Owner", DAY(2025, 10, 29), "Baseline: PSI, KS.", 1, True, True)
    assert (old.file, old.active, old.current) == (None, False, False) and b.last_review is None
    checks = {(r.file, r.check): r.threshold for r in R.policy_checks(spark, [f"{files}/a.yaml", f"{files}/b.json"]).collect()}
    assert checks["a.yaml", "performance.auroc"] == 0.6 and checks["b.json", "performance.auroc"] == 0.9 and len(checks) == 14


def entries(spark, rows):
    return spark.createDataFrame([("r", *r, None, None, None, False, cur) for *r, cur in rows],
                                 "registry string, policy_id string, version string, file string, last_review date, owner string, notes string, schema_version int, active boolean, current boolean")


def test_versions_in_time(spark):
    e = entries(spark, [("p", "1", "f1", DAY(2024, 1, 1), False), ("p", "2", "f2", DAY(2024, 6, 1), False), ("p", "3", "f3", DAY(2025, 1, 1), True),
                        ("p", "2b", "f2", DAY(2024, 6, 1), True), ("q", "1", "f1", None, True)])
    v = {(r.policy_id, r.version): (r.valid_from, r.valid_to) for r in R.policy_versions(e).collect()}
    assert v == {("p", "1"): (None, DAY(2024, 6, 1)), ("p", "2b"): (DAY(2024, 6, 1), DAY(2025, 1, 1)), ("p", "3"): (DAY(2025, 1, 1), None), ("q", "1"): (None, None)}


def test_runs_fall_under_the_version_of_their_day(spark):
    e = entries(spark, [("p", "1", "f1", DAY(2024, 1, 1), False), ("p", "2", None, DAY(2024, 6, 1), False), ("p", "3", "f3", DAY(2025, 1, 1), True)])
    checks = spark.createDataFrame([("f1", "auroc", "auroc", ">=", 0.5), ("f3", "auroc", "auroc", ">=", 0.9), ("f3", "psi", "max_psi", "<", 0.2)],
                                   "file string, check string, metric string, op string, threshold double")
    runs = spark.createDataFrame([("r0", "p", "2020-01-01", 0.7), ("r1", "p", "2024-05-31", 0.7), ("r2", "p", "2024-06-01", 0.7), ("r3", "p", "2025-01-01", 0.7),
                                  ("r4", "p", "2030-01-01", None), ("r5", "x", "2024-01-01", 0.7), ("r6", None, None, 0.7)],
                                 "run_id string, policy_id string, day string, auroc double").selectExpr("run_id", "policy_id", "timestamp(day) ts", "auroc")
    got = {(r.run_id, r.check): (r.version, r.result) for r in R.judge_runs(runs, R.policy_versions(e), checks).collect()}
    assert got == {("r0", "auroc"): ("1", "PASS"), ("r1", "auroc"): ("1", "PASS"), ("r2", None): ("2", "SKIP"), ("r3", "auroc"): ("3", "FAIL"), ("r3", "psi"): ("3", "SKIP"),
                   ("r4", "auroc"): ("3", "SKIP"), ("r4", "psi"): ("3", "SKIP"), ("r5", None): (None, "SKIP"), ("r6", None): (None, "SKIP")}


def test_roster(spark):
    roster = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "run_id string")
    live = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("z", 0.9), (None, 0.1)], "run_id string, auroc double")
    fair = spark.createDataFrame([("a",), ("a",)], "run_id string")
    violations = G.audit_violations(live, {"performance": {"min_auroc": 0.5}})
    got = {r.run_id: (r.expected, r.found, r.result, r.n_violations, r.missing, r.risk_score, r.risk_level)
           for r in G.audit_roster(roster, {"live": live, "fairness": fair}, violations).collect()}
    assert got == {"a": (True, True, "PASS", 0, [], 0, "LOW"), "b": (True, True, "SOFT-FAIL", 1, ["fairness"], 1, "LOW"),
                   "c": (True, False, "SKIPPED", 0, ["live", "fairness"], 3, "HIGH"), "z": (False, True, "PASS", 0, ["fairness"], 1, "LOW"),
                   None: (False, True, "SOFT-FAIL", 1, ["fairness"], 1, "LOW")}
    assert G.audit_roster(roster, {"live": live}, violations, strict=True).where("result = 'FAIL'").count() == 2
    plan = G.run_artifacts(roster, {"live": live, "fairness": fair})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
