"""Column-picker results as tables, with per-column counts read from the data.

The pickers themselves look only at schemas (``functions/columns.py``). These tables
add what a user checks next: how many usable values each picked column has. One
aggregate per side, map-side combined; the output has one row per column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import common_columns, drift_columns, infer_roles
from modelwatch.functions.scalar import is_finite

LINEITEM_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_ROLES = [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                  ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                  ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
                  ("l_linestatus", "categorical"), ("l_shipdate", "categorical")]


def _per_column(df: DataFrame, cols: Sequence[str], expr, name: str) -> DataFrame:
    row = df.agg(*[expr(c).cast("long").alias(c) for c in cols])
    return row.unpivot([], list(cols), "feature", name)


def _count_finite(c):
    return F.count_if(is_finite(c))


def _count_present(c):
    return F.count(F.col(c))


def drift_columns_table(baseline: DataFrame, current: DataFrame, ignore_cols=(),
                        gate_variant: bool = False) -> DataFrame:
    cols = drift_columns(baseline, current, ignore_cols, gate_variant)
    b = _per_column(baseline, cols, _count_finite, "n_base")
    c = _per_column(current, cols, _count_finite, "n_curr")
    return b.join(c, "feature")


def common_columns_table(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = common_columns(a, b)
    x = _per_column(a, cols, _count_present, "n_base")
    y = _per_column(b, cols, _count_present, "n_curr")
    return x.join(y, "feature")


def finite_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and finite (non-null, non-NaN, non-inf) values per column."""
    f = _per_column(df, cols, _count_finite, "n_finite")
    n = df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return f.select("feature", n.select("n_rows").scalar().alias("n_rows"), "n_finite")


def roles_table(df: DataFrame, target: str = "label") -> DataFrame:
    roles = infer_roles(df, target)
    if not roles:
        return df.sparkSession.createDataFrame([], "feature string, role string, n_present bigint")
    names = [c for c, _ in roles]
    counts = _per_column(df, names, _count_present, "n_present")
    role_col = F.col("feature")
    mapping = F.create_map(*[F.lit(x) for pair in roles for x in pair])
    return counts.select("feature", mapping[role_col].alias("role"), "n_present")


def split_columns_table(df: DataFrame, id_time_cols, num_cols) -> DataFrame:
    cols = list(id_time_cols) + list(num_cols)
    counts = _per_column(df, cols, _count_present, "n_present")
    kind = F.when(F.col("feature").isin(list(id_time_cols)), "id_time").otherwise("numeric")
    return counts.select("feature", kind.alias("kind"), "n_present")


# ---------------------------------------------------------------- SQL twins
def _sql_counts(src: str, cols, expr: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({expr.format(c=c)} AS BIGINT) AS {name} FROM ({src}) t_" for c in cols)


_FIN = "SUM(CASE WHEN {c} IS NOT NULL AND isfinite(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)"
_PRES = "COUNT({c})"


def drift_columns_sql(base: str, curr: str, cols) -> str:
    return (f"SELECT b.feature, b.n_base, c.n_curr FROM ({_sql_counts(base, cols, _FIN, 'n_base')}) b "
            f"JOIN ({_sql_counts(curr, cols, _FIN, 'n_curr')}) c ON b.feature = c.feature")


def common_columns_sql(base: str, curr: str, cols) -> str:
    return (f"SELECT b.feature, b.n_base, c.n_curr FROM ({_sql_counts(base, cols, _PRES, 'n_base')}) b "
            f"JOIN ({_sql_counts(curr, cols, _PRES, 'n_curr')}) c ON b.feature = c.feature")


def finite_counts_sql(src: str, cols) -> str:
    return (f"SELECT f.feature, (SELECT CAST(COUNT(*) AS BIGINT) FROM ({src}) s_) AS n_rows, f.n_finite "
            f"FROM ({_sql_counts(src, cols, _FIN, 'n_finite')}) f")


def roles_sql(src: str, roles) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{r}' AS role, CAST(COUNT({c}) AS BIGINT) AS n_present FROM ({src}) t_"
        for c, r in roles)


def split_columns_sql(src: str, id_cols, num_cols) -> str:
    parts = [(c, "id_time") for c in id_cols] + [(c, "numeric") for c in num_cols]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{k}' AS kind, CAST(COUNT({c}) AS BIGINT) AS n_present FROM ({src}) t_"
        for c, k in parts)
