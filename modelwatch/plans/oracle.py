"""SQL twins of the operators, for the DuckDB oracle.

Plain ANSI SQL over the driver's tables with global windows. The oracle is allowed to
be single-node and simple: it exists to check the distributed plans' numbers.
"""

from __future__ import annotations

from typing import Sequence


def _g(by: Sequence[str]) -> tuple[str, str]:
    """(select list for the group keys, group key list); a constant key when ungrouped."""
    if by:
        return ", ".join(by), ", ".join(by)
    return "1 AS _g", "_g"


def score_table_sql(src: str, by: Sequence[str] = ()) -> str:
    sel, G = _g(by)
    return f"""v AS (
  SELECT {sel}, CAST(y_score AS DOUBLE) AS score, TRY_CAST(y_true AS INTEGER) AS y FROM ({src}) src_
),
s AS (
  SELECT {G}, score,
         CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p,
         CAST(SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n
  FROM v WHERE y IN (0, 1) AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY {G}, score
),
r AS (
  SELECT *, SUM(p) OVER w AS cp, SUM(n) OVER w AS cn,
         SUM(p) OVER (PARTITION BY {G}) AS tot_p, SUM(n) OVER (PARTITION BY {G}) AS tot_n
  FROM s
  WINDOW w AS (PARTITION BY {G} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def metrics_sql(src: str, by: Sequence[str] = (), cols: Sequence[str] | None = None,
                thr: float = 0.5) -> str:
    """Same metric record as ``operators.metrics.performance_metrics``."""
    _, G = _g(by)
    clip = "least(greatest(score, 1e-15), 1 - 1e-15)"
    f1 = "CASE WHEN tp > 0 THEN CAST(2 AS DOUBLE) * tp / (tp + fp + P) ELSE 0.0 END"
    exprs = {
        "n": "CAST(P + N AS BIGINT) AS n",
        "n_samples": "CAST(P + N AS BIGINT) AS n_samples",
        "positive_rate": "round(CAST(P AS DOUBLE) / (P + N), 6) AS positive_rate",
        "accuracy_at_05": "round(CAST(correct AS DOUBLE) / (P + N), 6) AS accuracy_at_05",
        "f1_at_05": f"round({f1}, 6) AS f1_at_05",
        "best_f1_threshold": "round(bt, 6) AS best_f1_threshold",
        "best_f1": "round(bf1, 6) AS best_f1",
        "auroc": "round(CASE WHEN P > 0 AND N > 0 THEN U / (CAST(P AS DOUBLE) * N) END, 6) AS auroc",
        "ks_stat": "round(CASE WHEN P > 0 AND N > 0 THEN ks END, 6) AS ks_stat",
        "auprc": "round(CASE WHEN P > 0 THEN auprc END, 6) AS auprc",
        "log_loss": "round(ll / (P + N), 6) AS log_loss",
        "tp": "CAST(tp AS BIGINT) AS tp", "fp": "CAST(fp AS BIGINT) AS fp",
        "fn": "CAST(P - tp AS BIGINT) AS fn",
        "precision_at_05": "round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 6) AS precision_at_05",
        "recall_at_05": "round(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0.0 END, 6) AS recall_at_05",
    }
    from modelwatch.operators.metrics import METRIC_COLUMNS
    cols = list(cols or METRIC_COLUMNS)
    keys = ", ".join(f"m.{b}" for b in by)
    sel = (keys + ", " if by else "") + ", ".join(exprs[c] for c in cols)
    return f"""WITH {score_table_sql(src, by)},
g AS (
  SELECT {G}, MAX(tot_p) AS P, MAX(tot_n) AS N,
         SUM(CASE WHEN score >= {thr} THEN p ELSE n END) AS correct,
         SUM(CASE WHEN score >= {thr} THEN p ELSE 0 END) AS tp,
         SUM(CASE WHEN score >= {thr} THEN n ELSE 0 END) AS fp,
         SUM(p * -ln({clip}) + n * -ln(1 - {clip})) AS ll,
         SUM(p * (CAST(cn - n AS DOUBLE) + 0.5 * n)) AS U,
         MAX(CASE WHEN tot_p > 0 AND tot_n > 0
                  THEN abs(CAST(cp AS DOUBLE) / tot_p - CAST(cn AS DOUBLE) / tot_n) END) AS ks,
         SUM(CASE WHEN tot_p > 0 THEN CAST(tot_p - cp + p AS DOUBLE) / (tot_p - cp + p + tot_n - cn + n)
                  * (CAST(p AS DOUBLE) / tot_p) END) AS auprc
  FROM r GROUP BY {G}
),
cand AS (
  SELECT {G}, score AS t, tot_p - cp + p AS tp, tot_n - cn + n AS fp, tot_p AS P FROM r
  UNION ALL
  SELECT {G}, 0.0 AS t, SUM(CASE WHEN score >= 0.0 THEN p ELSE 0 END), SUM(CASE WHEN score >= 0.0 THEN n ELSE 0 END), MAX(tot_p)
  FROM r GROUP BY {G}
  UNION ALL
  SELECT {G}, 1.0 AS t, SUM(CASE WHEN score >= 1.0 THEN p ELSE 0 END), SUM(CASE WHEN score >= 1.0 THEN n ELSE 0 END), MAX(tot_p)
  FROM r GROUP BY {G}
),
f AS (SELECT {G}, CAST(t AS DOUBLE) AS t, {f1} AS f1 FROM cand),
b AS (
  SELECT {G}, t AS bt, f1 AS bf1 FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {G} ORDER BY f1 DESC, abs(t - 0.5), t) AS rn FROM f) x
  WHERE rn = 1
),
m AS (SELECT g.*, b.bt, b.bf1 FROM g JOIN b USING ({G}))
SELECT {sel} FROM m"""


def average_rank_sql(src: str, by: Sequence[str] = ()) -> str:
    keys = ", ".join(by) + ", " if by else ""
    return f"""WITH {score_table_sql(src, by)}
SELECT {keys}score, CAST(p + n AS BIGINT) AS n_ties,
       CAST(cp + cn AS DOUBLE) - CAST(p + n - 1 AS DOUBLE) / 2 AS avg_rank FROM r"""


def running_counts_sql(src: str, by: Sequence[str] = ()) -> str:
    keys = ", ".join(by) + ", " if by else ""
    return f"""WITH {score_table_sql(src, by)}
SELECT {keys}score, p, n, CAST(cp AS BIGINT) AS cum_p, CAST(cn AS BIGINT) AS cum_n FROM r"""


# ---------------------------------------------------------------- drift
def _lerp(lo: str, hi: str, t: str) -> str:
    return f"(CASE WHEN {t} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1 - {t}) ELSE {lo} + ({hi} - {lo}) * {t} END)"


def _unpivot(src: str, cols, side: str, kind: str = "DOUBLE", name: str = "value") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS {kind}) AS {name}, '{side}' AS side FROM ({src}) t_"
        for c in cols)


def drift_core_sql(base: str, curr: str, cols, bins: int = 10) -> str:
    """CTEs: lf (finite long rows), ks, pc (baseline p1/p99), hist, psi."""
    edge_terms = " + ".join(
        f"CASE WHEN value >= p1 + CAST({i} AS DOUBLE) * step THEN 1 ELSE 0 END" for i in range(1, bins))
    hist_cols = ", ".join(
        f"SUM(CASE WHEN side = 'b' AND bin = {k} THEN 1 ELSE 0 END) AS b{k}, "
        f"SUM(CASE WHEN side = 'c' AND bin = {k} THEN 1 ELSE 0 END) AS c{k}" for k in range(1, bins + 1))
    tb = " + ".join(f"b{k}" for k in range(1, bins + 1))
    tc = " + ".join(f"c{k}" for k in range(1, bins + 1))

    def share(x, t):
        return f"least(greatest(CAST({x} AS DOUBLE) / greatest({t}, 1), 1e-6), 1.0)"
    psi_terms = " + ".join(
        f"({share(f'c{k}', 'tc')} - {share(f'b{k}', 'tb')}) * ln({share(f'c{k}', 'tc')} / {share(f'b{k}', 'tb')})"
        for k in range(1, bins + 1))
    h1, h99 = "(n - 1) * CAST(0.01 AS DOUBLE)", "(n - 1) * CAST(0.99 AS DOUBLE)"
    return f"""l AS ({_unpivot(base, cols, 'b')} UNION ALL {_unpivot(curr, cols, 'c')}),
lf AS (SELECT * FROM l WHERE value IS NOT NULL AND isfinite(value)),
cnt AS (SELECT feature, value, SUM(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS nb,
               SUM(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS nc FROM lf GROUP BY feature, value),
rt AS (SELECT *, SUM(nb) OVER w AS cb, SUM(nc) OVER w AS cc,
              SUM(nb) OVER (PARTITION BY feature) AS tnb, SUM(nc) OVER (PARTITION BY feature) AS tnc
       FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT feature, MAX(abs(CAST(cb AS DOUBLE) / tnb - CAST(cc AS DOUBLE) / tnc)) AS ks
       FROM rt WHERE tnb > 0 AND tnc > 0 GROUP BY feature),
bs AS (SELECT feature, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn,
              COUNT(*) OVER (PARTITION BY feature) AS n FROM lf WHERE side = 'b'),
pq AS (SELECT feature, n,
              MAX(CASE WHEN rn = floor({h1}) THEN value END) AS lo1,
              MAX(CASE WHEN rn = least(floor({h1}) + 1, n - 1) THEN value END) AS hi1,
              MAX(CASE WHEN rn = floor({h99}) THEN value END) AS lo99,
              MAX(CASE WHEN rn = least(floor({h99}) + 1, n - 1) THEN value END) AS hi99,
              {h1} - floor({h1}) AS t1, {h99} - floor({h99}) AS t99
       FROM bs GROUP BY feature, n),
pc AS (SELECT feature, n AS n_base, {_lerp('lo1', 'hi1', 't1')} AS p1, {_lerp('lo99', 'hi99', 't99')} AS p99
       FROM pq WHERE feature IN (SELECT feature FROM ks)),
ed AS (SELECT *, (p99 - p1) / CAST({bins} AS DOUBLE) AS step FROM pc),
bn AS (SELECT lf.feature, lf.side, 1 + {edge_terms} AS bin
       FROM lf JOIN ed ON lf.feature = ed.feature WHERE value >= p1 AND value <= p99),
hist AS (SELECT feature, {hist_cols} FROM bn GROUP BY feature),
ht AS (SELECT *, {tb} AS tb, {tc} AS tc FROM hist),
psi AS (SELECT feature, {psi_terms} AS psi FROM ht)"""


def drift_sql(base: str, curr: str, cols, what: str = "full", bins: int = 10) -> str:
    core = drift_core_sql(base, curr, cols, bins)
    if what == "sketched":
        flag = "psi >= 0.1 OR ks >= 0.1"
        return (f"WITH {core} SELECT feature, (SELECT count(*) FROM lf WHERE lf.feature = psi.feature AND side = 'b') AS n_base, "
                f"(SELECT count(*) FROM lf WHERE lf.feature = psi.feature AND side = 'c') AS n_curr, "
                f"true AS psi_within, true AS ks_within, {flag} AS drift_flag FROM psi JOIN ks USING (feature)")
    if what == "psi":
        return f"WITH {core} SELECT feature, round(psi, 6) AS psi FROM psi"
    if what == "ks":
        return f"WITH {core} SELECT feature, round(ks, 6) AS ks FROM ks"
    if what == "edges":
        return (f"WITH {core} SELECT feature, CAST(n_base AS BIGINT) AS n_base, round(p1, 6) AS p1, "
                f"round(p99, 6) AS p99 FROM pc")
    full = (f"SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, (psi >= 0.1 OR ks >= 0.1) AS drift_flag "
            f"FROM psi JOIN ks USING (feature)")
    if what == "max":
        return f"WITH {core}, d AS ({full}) SELECT MAX(psi) AS max_psi, MAX(ks) AS max_ks FROM d"
    return f"WITH {core} {full}"


def categorical_psi_sql(base: str, curr: str, cols) -> str:
    def share(x, t):
        return f"least(greatest(CAST({x} AS DOUBLE) / greatest({t}, 1), 1e-6), 1.0)"
    return f"""l AS ({_unpivot(base, cols, 'b', 'VARCHAR', 'category')} UNION ALL
               {_unpivot(curr, cols, 'c', 'VARCHAR', 'category')}),
cc AS (SELECT feature, category, SUM(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS nb,
              SUM(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS nc FROM l WHERE category IS NOT NULL
       GROUP BY feature, category),
ct AS (SELECT *, SUM(nb) OVER (PARTITION BY feature) AS tb, SUM(nc) OVER (PARTITION BY feature) AS tc FROM cc),
cpsi AS (SELECT feature, SUM(({share('nc', 'tc')} - {share('nb', 'tb')}) * ln({share('nc', 'tc')} / {share('nb', 'tb')})) AS psi
         FROM ct WHERE tb > 0 AND tc > 0 GROUP BY feature)"""


def drift_report_sql(base: str, curr: str, num_cols, cat_cols, summary: bool = False) -> str:
    parts = []
    ctes = []
    if num_cols:
        ctes.append(drift_core_sql(base, curr, num_cols))
        parts.append("SELECT feature, 'numeric' AS kind, psi, ks FROM psi JOIN ks USING (feature)")
    if cat_cols:
        ctes.append(categorical_psi_sql(base, curr, cat_cols).replace("l AS (", "lc AS (", 1)
                    .replace("FROM l WHERE category", "FROM lc WHERE category"))
        parts.append("SELECT feature, 'categorical' AS kind, psi, CAST(NULL AS DOUBLE) AS ks FROM cpsi")
    body = " UNION ALL ".join(parts)
    rep = (f"SELECT feature, kind, round(psi, 6) AS psi, round(ks, 6) AS ks, "
           f"(psi >= 0.1 OR coalesce(ks >= 0.1, false)) AS drift_flag FROM ({body}) u")
    if summary:
        return (f"WITH {', '.join(ctes)}, rep AS ({rep}) SELECT CAST(COUNT(*) AS BIGINT) AS n_columns, "
                f"CAST(SUM(CASE WHEN drift_flag THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted, "
                f"round(CAST(SUM(CASE WHEN drift_flag THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS drift_share, "
                f"coalesce(CAST(SUM(CASE WHEN drift_flag THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) >= 0.5, false) "
                f"AS dataset_drift FROM rep")
    return f"WITH {', '.join(ctes)} {rep}"


# ---------------------------------------------------------------- prep
TINY = "2.220446049250313e-15"


def round_cols(sel_cols, dbl_cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in dbl_cols else c for c in sel_cols)


def _impute_sql(src: str, num, other, strategy: str, name: str) -> str:
    if strategy == "drop":
        cond = " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in num)
        return f"{name} AS (SELECT * FROM ({src}) s_ WHERE {cond})"
    if strategy == "zero":
        cols = ", ".join([f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in num] + list(other))
        return f"{name} AS (SELECT {cols} FROM ({src}) s_)"
    meds = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md_{c}" for c in num)
    cols = ", ".join([f"coalesce(CAST({c} AS DOUBLE), md_{c}) AS {c}" for c in num] + list(other))
    return (f"{name}_md AS (SELECT {meds} FROM ({src}) s_), "
            f"{name} AS (SELECT {cols} FROM ({src}) s_, {name}_md)")


def _clip_sql(prev: str, num, other, method: str, name: str, z: float = 4.0, m: float = 1.5) -> str:
    if method == "none":
        return f"{name} AS (SELECT * FROM {prev})"
    if method == "zscore":
        st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in num)
        cols = ", ".join([
            f"CASE WHEN sd_{c} IS NULL OR isnan(sd_{c}) OR sd_{c} = 0 OR {c} IS NULL THEN CAST({c} AS DOUBLE) "
            f"ELSE least(greatest(CAST({c} AS DOUBLE), mu_{c} - {z} * sd_{c}), mu_{c} + {z} * sd_{c}) END AS {c}"
            for c in num] + list(other))
    else:
        st = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, "
                       f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}" for c in num)
        cols = ", ".join([
            f"CASE WHEN q1_{c} IS NULL OR {c} IS NULL THEN CAST({c} AS DOUBLE) "
            f"ELSE least(greatest(CAST({c} AS DOUBLE), q1_{c} - {m} * (q3_{c} - q1_{c})), "
            f"q3_{c} + {m} * (q3_{c} - q1_{c})) END AS {c}" for c in num] + list(other))
    return f"{name}_st AS (SELECT {st} FROM {prev}), {name} AS (SELECT {cols} FROM {prev}, {name}_st)"


def prep_sql(base_src: str, cur_src: str, num, other, impute="drop", outliers="zscore",
             scaler="standard", side="current", what="frame") -> str:
    """Same pipeline as ``operators.prep.prepare_pair`` (frames rounded to 6 places)."""
    ctes = [_impute_sql(base_src, num, other, impute, "b1"), _clip_sql("b1", num, other, outliers, "b2"),
            _impute_sql(cur_src, num, other, impute, "c1"), _clip_sql("c1", num, other, outliers, "c2")]
    if scaler == "standard":
        fit = ", ".join(f"avg({c}) AS ce_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) < {TINY} "
                        f"THEN 1.0 ELSE stddev_pop({c}) END AS sc_{c}" for c in num)
    elif scaler == "minmax":
        fit = ", ".join(f"min({c}) AS ce_{c}, CASE WHEN max({c}) - min({c}) IS NULL OR max({c}) - min({c}) < {TINY} "
                        f"THEN 1.0 ELSE max({c}) - min({c}) END AS sc_{c}" for c in num)
    else:
        fit = None
    ctes.append(f"fit AS (SELECT {fit} FROM b2)" if fit else "fit AS (SELECT 1 AS no_fit)")
    src = "b2" if side == "baseline" else "c2"
    if scaler == "none":
        scaled = ", ".join([f"CAST({c} AS DOUBLE) AS {c}" for c in num] + list(other))
    else:
        scaled = ", ".join([f"(CAST({c} AS DOUBLE) - ce_{c}) / sc_{c} AS {c}" for c in num] + list(other))
    ctes.append(f"out AS (SELECT {scaled} FROM {src}, fit)")
    if what == "frame":
        return f"WITH {', '.join(ctes)} SELECT {round_cols(list(num) + list(other), set(num))} FROM out"
    if what == "profile":
        return f"WITH {', '.join(ctes)} {profile_sql('out', num)}"
    raise ValueError(what)


def profile_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, CAST(COUNT({c}) AS BIGINT) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_pop({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.5), 6) AS p50, round(max({x}), 6) AS max, "
            f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM {src}")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- cohort
def cohort_ctes(events: str, admissions: str, patients: str, items: str, targets: dict, window: str) -> str:
    labels = ", ".join(f"'{t}'" for t in targets)
    pivot = ", ".join(f"avg(CASE WHEN label = '{t}' THEN value END) AS {s}" for t, s in targets.items())
    idx = "subject_id, hadm_id, admission_type, anchor_age, anchor_year_group, gender"
    keys_nn = " AND ".join(f"{k} IS NOT NULL" for k in idx.split(", ") + ["label"])
    return f"""t AS (SELECT DISTINCT itemid, upper(label) AS label FROM ({items}) i_ WHERE upper(label) IN ({labels})),
labs AS (SELECT e.subject_id, e.hadm_id, e.charttime, e.itemid, e.valuenum, t.label
         FROM ({events}) e JOIN t ON e.itemid = t.itemid
         WHERE e.valuenum IS NOT NULL AND NOT isnan(e.valuenum) AND e.valuenum > -1e6 AND e.valuenum < 1e6),
adm AS ({admissions}),
j AS (SELECT labs.*, adm.admittime, adm.admission_type FROM labs JOIN adm
      ON labs.subject_id = adm.subject_id AND labs.hadm_id = adm.hadm_id
      WHERE labs.charttime >= adm.admittime AND labs.charttime <= adm.admittime + INTERVAL {window}),
pat AS ({patients}),
jp AS (SELECT j.*, pat.gender, pat.anchor_age, pat.anchor_year_group FROM j LEFT JOIN pat ON j.subject_id = pat.subject_id),
med AS (SELECT {idx}, label, median(valuenum) AS value FROM jp WHERE {keys_nn} GROUP BY {idx}, label),
wide AS (SELECT {idx}, {pivot} FROM med GROUP BY {idx}),
fa AS (SELECT hadm_id, min(admittime) AS charttime FROM adm GROUP BY hadm_id),
cw AS (SELECT w.subject_id, w.hadm_id, w.anchor_age, coalesce(w.gender, 'Unknown') AS gender, w.admission_type,
              {', '.join('w.' + s for s in targets.values())}, fa.charttime, w.anchor_year_group
       FROM wide w LEFT JOIN fa ON w.hadm_id = fa.hadm_id),
sp AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY subject_id, hadm_id, charttime) - 1 AS BIGINT) AS position,
              COUNT(*) OVER () AS n_rows FROM cw),
cohort AS (SELECT * EXCLUDE (n_rows), CASE WHEN position < n_rows // 2 THEN 'baseline' ELSE 'current' END AS split FROM sp)"""
