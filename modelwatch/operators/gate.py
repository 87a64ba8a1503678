"""Policy gates over per-run metric tables.

A policy is a small configuration (a handful of thresholds), so checks are built as
literal structs and exploded per run: no join, no shuffle, and a metric missing from a
run is simply NULL there (-> SKIP / fail / pass according to the gate's null rule).
Run status comes from array functions over that run's checks, in the same projection.
"""

from __future__ import annotations

import copy
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the reference: the policy file's thresholds and the gate defaults.
DEFAULT_POLICY = {
    "version": 1,
    "drift": {"psi_warn": 0.10, "psi_fail": 0.20, "ks_warn": 0.10, "ks_fail": 0.20,
              "ignore_cols": ["subject_id", "hadm_id", "itemid", "stay_id", "label", "y_true", "y_pred",
                              "y_score", "admittime", "dischtime", "charttime"]},
    "fairness": {"parity_gap_fail": 0.05},
    "explainability": {"top_features_min": 2, "require_shap_artifact": True},
    "performance": {"min_auroc": 0.75, "min_auprc": 0.20},
    "gate": {"min_auroc": 0.70, "min_ks": 0.10, "fail_closed": True},
    "explain": {"top_k": 10},
    "audit": {"fairness_placeholder_ok": True},
}
GATE_DEFAULTS = {"min_auroc": 0.70, "min_ks": 0.10}
PASS_WORDS = ("pass", "passed", "success")
NO_GATE = "Gate unavailable; failing closed."

OBSERVED_COLUMNS = ["max_psi", "max_ks", "auroc", "auprc", "log_loss", "parity_gap",
                    "shap_artifact_present", "top_features_detected"]


def load_policy(path: str | None = None) -> dict:
    """Policy from a YAML file (driver-side configuration read); defaults otherwise."""
    if path is None:
        return copy.deepcopy(DEFAULT_POLICY)
    try:
        import yaml
    except ImportError as e:  # a given policy must never be ignored
        raise RuntimeError(f"reading the policy file {path} needs a YAML module") from e
    with open(path, encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def check_specs(policy: dict) -> list[tuple[str, str, str, float]]:
    """(check name, observed metric, op, threshold), the seven checks of the gate."""
    d, p = policy.get("drift", {}) or {}, policy.get("performance", {}) or {}
    f, x = policy.get("fairness", {}) or {}, policy.get("explainability", {}) or {}
    return [
        ("drift.psi", "max_psi", "<", float(d.get("psi_fail", 0.2))),
        ("drift.ks", "max_ks", "<", float(d.get("ks_fail", 0.2))),
        ("performance.auroc", "auroc", ">=", float(p.get("min_auroc", 0.75))),
        ("performance.auprc", "auprc", ">=", float(p.get("min_auprc", 0.2))),
        ("fairness.parity_gap", "parity_gap", "<=", float(f.get("parity_gap_fail", 0.05))),
        ("explainability.shap_artifact_present", "shap_artifact_present", "==",
         1.0 if bool(x.get("require_shap_artifact", True)) else 0.0),
        ("explainability.top_features_min", "top_features_detected", ">=", float(int(x.get("top_features_min", 2)))),
    ]


def policy_table(spark: SparkSession, policy: dict | None = None) -> DataFrame:
    """The checks as a small table (check, metric, op, threshold)."""
    rows = check_specs(policy or DEFAULT_POLICY)
    return spark.createDataFrame(rows, "check string, metric string, op string, threshold double")


def _compare(v: Column, op: str, thr: float) -> Column:
    t = F.lit(thr)
    return {"<": v < t, "<=": v <= t, ">=": v >= t, "==": v == t}[op]


def gate_checks(observed: DataFrame, policy: dict | None = None, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per (run, check): name, value, op, threshold, result PASS / FAIL / SKIP,
    plus the run's status (FAIL if any check FAILs; SKIP never fails). A missing
    attribution artifact is a value of 0, never SKIP."""
    run_cols = list(run_cols)
    structs = []
    for name, metric, op, thr in check_specs(policy or DEFAULT_POLICY):
        v = F.col(metric).cast("double") if metric in observed.columns else F.lit(None).cast("double")
        if metric == "shap_artifact_present":      # unknown counts as absent, so the gate fails closed
            v = F.coalesce(v, F.lit(0.0))
        res = F.when(v.isNull(), "SKIP").when(_compare(v, op, thr), "PASS").otherwise("FAIL")
        structs.append(F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(op).alias("op"),
                                F.lit(thr).alias("threshold"), res.alias("result")))
    arr = F.array(*structs)
    status = F.when(F.exists(arr, lambda c: c["result"] == "FAIL"), "FAIL").otherwise("PASS")
    return observed.select(*run_cols, status.alias("status"), F.explode(arr).alias("c")) \
                   .select(*run_cols, "status", "c.name", "c.value", "c.op", "c.threshold", "c.result")


def gate_status(checks: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    return checks.select(*run_cols, "status").distinct()


def gate_basic(metrics: DataFrame, run_cols: Sequence[str] = ("run_id",), min_auroc: float = 0.70,
               min_ks: float = 0.10) -> DataFrame:
    """AUROC >= min (NULL AUROC fails), KS >= min (NULL KS passes); reasons 'auroc<0.7',
    'ks<0.1'. Observed max_ks is the run's KS."""
    a, k = F.col("auroc"), F.col("ks_stat")
    bad_a = a.isNull() | (a < min_auroc)
    bad_k = k.isNotNull() & (k < min_ks)
    reasons = F.array_compact(F.array(F.when(bad_a, F.lit(f"auroc<{min_auroc}")),
                                      F.when(bad_k, F.lit(f"ks<{min_ks}"))))
    return metrics.select(*run_cols, F.when(bad_a | bad_k, "FAIL").otherwise("PASS").alias("status"),
                          F.lit(min_auroc).alias("min_auroc"), F.lit(min_ks).alias("min_ks"),
                          reasons.alias("reasons"), k.alias("max_ks"))


def _num_text(c: Column) -> Column:
    """Plain decimal text, also below 0.001 where the cast would switch to an exponent."""
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-18), plain).otherwise(c.cast("string"))


def gate_required(metrics: DataFrame, run_cols: Sequence[str] = ("run_id",), min_auroc: float | None = 0.70,
                  min_ks: float | None = 0.10) -> DataFrame:
    """Both AUROC and KS required: 'AUROC missing' / 'AUROC x < min_auroc t', same for KS."""
    a, k = F.col("auroc"), F.col("ks_stat")

    def reason(v, label, key, thr):
        if thr is None:
            return F.lit(f"{label} missing")
        return F.when(v.isNull(), F.lit(f"{label} missing")).when(
            v < thr, F.concat(F.lit(f"{label} "), _num_text(v), F.lit(f" < {key} {thr}")))
    reasons = F.array_compact(F.array(reason(a, "AUROC", "min_auroc", min_auroc), reason(k, "KS", "min_ks", min_ks)))
    return metrics.select(*run_cols, F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS").alias("status"),
                          reasons.alias("reasons"))


def gate_fallback(metrics: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """NULL counts as 0; PASS when AUROC >= 0.7 and KS >= 0.1; no reasons."""
    a = F.coalesce(F.col("auroc"), F.lit(0.0))
    k = F.coalesce(F.col("ks_stat"), F.lit(0.0))
    return metrics.select(*run_cols, F.when((a >= 0.7) & (k >= 0.1), "PASS").otherwise("FAIL").alias("status"),
                          F.col("ks_stat").alias("max_ks"))


def audit_violations(observed: DataFrame, policy: dict | None = None, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Violation texts per run (performance, drift, fairness, explainability checks).

    Observed columns: auroc, auprc, log_loss, psi, ks, parity_gap, shap_artifact_present,
    top_features_count (missing columns count as absent -> the check is skipped)."""
    policy = policy or DEFAULT_POLICY
    p, d = policy.get("performance", {}) or {}, policy.get("drift", {}) or {}
    f, x = policy.get("fairness", {}) or {}, policy.get("explainability", {}) or {}

    def col(c):
        return F.col(c).cast("double") if c in observed.columns else F.lit(None).cast("double")

    def fmt(text, *cols):
        return F.format_string(text, *cols)

    texts = []
    rules = [("auroc", "min_auroc", p, "<", "AUROC %.3f < min_auroc %.3f"),
             ("auprc", "min_auprc", p, "<", "AUPRC %.3f < min_auprc %.3f"),
             ("log_loss", "max_log_loss", p, ">", "log_loss %.3f > max_log_loss %.3f"),
             ("psi", "psi_fail", d, ">", "PSI %.3f > psi_fail %.3f"),
             ("ks", "ks_fail", d, ">", "KS %.3f > ks_fail %.3f")]
    for metric, key, sect, op, text in rules:
        if sect.get(key) is None:
            continue
        v, t = col(metric), F.lit(float(sect[key]))
        cond = (v < t) if op == "<" else (v > t)
        texts.append(F.when(v.isNotNull() & cond, fmt(text, v, t)))
    if f.get("parity_gap_fail") is not None:
        v, t = col("parity_gap"), F.lit(float(f["parity_gap_fail"]))
        texts.append(F.when(v.isNotNull() & (F.abs(v) > t), fmt("parity_gap %.3f exceeds %.3f", v, t)))
    if bool(x.get("require_shap_artifact", False)):
        has = F.coalesce(col("shap_artifact_present") > 0, F.lit(False))
        texts.append(F.when(~has, F.lit("SHAP artifact required but missing")))
    if x.get("top_features_min") is not None:
        n, t = col("top_features_count").cast("long"), int(x["top_features_min"])
        texts.append(F.when(n.isNotNull() & (n < t), F.concat(F.lit("top_features_count "), n.cast("string"),
                                                              F.lit(f" < required {t}"))))
    return observed.select(*run_cols, F.array_compact(F.array(*texts)).alias("violations"))


def audit_result(violations: DataFrame, strict: bool = False, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """PASS when no violation; else FAIL (strict) or SOFT-FAIL."""
    v = F.col("violations")
    res = F.when(v.isNull(), "SKIPPED").when(F.size(v) == 0, "PASS").otherwise("FAIL" if strict else "SOFT-FAIL")
    return violations.select(*run_cols, res.alias("result"), F.size(v).alias("n_violations"), "violations")


def run_artifacts(roster: DataFrame, tables: dict[str, DataFrame], run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Full outer join of the expected runs with the records found: run columns, ``expected``,
    and one boolean per artifact of ``tables``.

    A union of run keys and one grouped aggregate, combined before its shuffle, in place of a
    chain of joins: a run with many records is one row per task. Rows without a run are one run."""
    marks = ["expected", *tables]
    both = None
    for mark, df in {"expected": roster, **tables}.items():
        part = df.select(*run_cols, F.lit(mark).alias("_mark"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*run_cols).agg(*[F.max(F.col("_mark") == m).alias(m) for m in marks])


def audit_roster(roster: DataFrame, tables: dict[str, DataFrame], violations: DataFrame, live: str = "live",
                 strict: bool = False, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """The audit of every run that is expected or found: run columns, expected, found, result,
    n_violations, violations, missing (artifacts of an expected run that aren't there), and the
    risk of what is missing (+1 an artifact, +2 a run without its record).

    ``live`` names the table of ``tables`` whose record the audit needs: without it a run is
    SKIPPED. A run that nobody expected is audited like any other."""
    names = list(tables)
    runs = run_artifacts(roster, tables, run_cols)
    keyed = [F.col(f"a.{c}").eqNullSafe(F.col(f"v.{c}")) for c in run_cols]
    on = keyed[0]
    for k in keyed[1:]:
        on = on & k
    j = runs.alias("a").join(violations.select(*run_cols, "violations").alias("v"), on, "left")
    own = F.when(F.col(f"`{live}`"), F.coalesce("violations", F.array().cast("array<string>")))
    missing = F.array_compact(F.array(*[F.when(~F.col(f"`{n}`"), F.lit(n)) for n in names]))
    result = F.when(own.isNull(), "SKIPPED").when(F.size(own) == 0, "PASS").otherwise("FAIL" if strict else "SOFT-FAIL")
    risk = F.size(missing) + F.when(~F.col(f"`{live}`"), 1).otherwise(0)
    return j.select(*[F.col(f"a.{c}").alias(c) for c in run_cols], "expected", F.col(f"`{live}`").alias("found"), result.alias("result"),
                    F.when(own.isNull(), 0).otherwise(F.size(own)).alias("n_violations"), own.alias("violations"), missing.alias("missing"),
                    risk.alias("risk_score"), F.when(risk <= 1, "LOW").when(risk == 2, "MEDIUM").otherwise("HIGH").alias("risk_level"))


def gate_status_normalize(df: DataFrame, status: str = "status", alt: str = "gate_status") -> Column:
    """pass / passed / success -> 'pass'; anything else or absent -> 'fail' (fail closed)."""
    s = F.col(status) if status in df.columns else F.lit(None).cast("string")
    a = F.col(alt) if alt in df.columns else F.lit(None).cast("string")
    raw = F.lower(F.coalesce(F.when(F.length(s) > 0, s), a, F.lit("")))
    return F.when(raw.isin(*PASS_WORDS), "pass").otherwise("fail")


def live_validation(perf: DataFrame, gate: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Final record per run: status, performance {n, accuracy, auroc, ks}, gate {status,
    policy, reasons}. A run without a gate record fails, with a reason that says so."""
    policy = F.struct(*[(F.col(c) if c in gate.columns else F.lit(None)).cast("double").alias(c) for c in GATE_DEFAULTS])
    g = gate.select(*run_cols, F.col("status").alias("_gs"), F.col("reasons").alias("_gr"), policy.alias("_gp"),
                    F.lit(True).alias("_there"))
    j = perf.join(g, list(run_cols), "left")
    st = F.coalesce(F.col("_gs"), F.lit("FAIL"))
    return j.select(*run_cols, st.alias("status"),
                    F.struct(F.col("n"), F.col("accuracy_at_05"), F.col("auroc"), F.col("ks_stat")).alias("performance"),
                    F.struct(F.when(st == "PASS", "pass").otherwise("fail").alias("status"),
                             F.col("_gp").alias("policy"),
                             F.when(F.col("_there").isNull(), F.array(F.lit(NO_GATE)))
                             .otherwise(F.coalesce(F.col("_gr"), F.array().cast("array<string>"))).alias("reasons")).alias("gate"))


def threshold_table(metrics: DataFrame, run_cols: Sequence[str] = ("run_id",), policy: dict | None = None) -> DataFrame:
    """metric, actual, threshold, status PASS / FAIL / '—' (and WARN between warn and
    fail levels for drift rows, from the policy's otherwise unused warn levels)."""
    policy = policy or DEFAULT_POLICY
    g = policy.get("gate", GATE_DEFAULTS) or GATE_DEFAULTS
    d = policy.get("drift", {}) or {}
    rows = [("AUROC", "auroc", g.get("min_auroc"), True, None),
            ("KS Statistic", "ks_stat", g.get("min_ks"), True, None)]
    if "max_psi" in metrics.columns:
        rows.append(("Max PSI", "max_psi", d.get("psi_fail"), False, d.get("psi_warn")))
    structs = []
    for label, c, thr, higher, warn in rows:
        a = F.col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double")
        t = F.lit(thr).cast("double")
        ok = (a >= t) if higher else (a <= t)
        st = F.when(a.isNull() | t.isNull(), "—").when(~ok, "FAIL")
        if warn is not None:
            st = st.when(a > F.lit(float(warn)), "WARN")
        st = st.otherwise("PASS")
        structs.append(F.struct(F.lit(label).alias("metric"), a.alias("actual"), t.alias("threshold"), st.alias("status")))
    return metrics.select(*run_cols, F.explode(F.array(*structs)).alias("r")).select(*run_cols, "r.*")


def risk_score(runs: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """+2 gate not PASS, +1 each for missing performance, fairness, explainability;
    LOW <= 1, MEDIUM = 2, else HIGH."""
    gate = F.upper(F.coalesce(F.nullif(F.col("gate_status"), F.lit("")), F.lit("FAIL")))
    has_perf = F.col("auroc").isNotNull() & F.col("ks_stat").isNotNull()
    has_fair = F.coalesce(F.col("n_fairness_slices") > 0, F.lit(False))
    has_expl = F.coalesce(F.col("n_top_features") > 0, F.lit(False))
    score = (F.when(gate != "PASS", 2).otherwise(0) + F.when(~has_perf, 1).otherwise(0)
             + F.when(~has_fair, 1).otherwise(0) + F.when(~has_expl, 1).otherwise(0))
    level = F.when(score <= 1, "LOW").when(score == 2, "MEDIUM").otherwise("HIGH")
    return runs.select(*run_cols, gate.alias("policy_gate"), has_perf.alias("performance_present"),
                       has_fair.alias("fairness_present"), has_expl.alias("explainability_present"),
                       score.alias("risk_score"), level.alias("risk_level"))


def policy_registry(spark: SparkSession, registry: dict, policies: dict[str, dict]) -> DataFrame:
    """Flatten registry entries with each policy file's checks (one row per check)."""
    rows = []
    for e in registry.get("policies", []) or []:
        if e.get("file") not in policies:
            raise KeyError(f"policy file {e.get('file')} of policy {e.get('id')} was not given")
        pol = policies[e["file"]]
        for check, metric, op, thr in check_specs(pol):
            rows.append((str(e.get("id")), str(e.get("version")), bool(e.get("active", False)),
                         check, metric, op, float(thr)))
    return spark.createDataFrame(rows, "policy_id string, version string, active boolean, check string, "
                                       "metric string, op string, threshold double")
