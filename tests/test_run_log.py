"""Run logs read incrementally, JSON documents of any shape, the manifest's parts."""
import json

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import attribution as A
from modelwatch.operators import prep as P
from modelwatch.sources import files as S


def put(root, exp, run, kind, name, text):
    d = root / exp / run / kind
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text(text)


def table(spark, path):
    return sorted((tuple(r) for r in S.read_run_log(spark, path).select("run_id", "kind", "name", "ts", "value", "text", "step").collect()), key=str)


def test_only_new_files_and_no_doubles(spark, tmp_path):
    root, out, check = tmp_path / "mlruns", str(tmp_path / "t"), str(tmp_path / "c")
    put(root, "0", "r1", "metrics", "auroc", "1700000000 0.75 0\n1700000001 0.8 1\n")
    put(root, "0", "r1", "params", "lr", "0.1\nsecond line")
    put(root, "0", "r1", "other", "x", "not a kind")
    (root / "0" / "r1" / "meta.yaml").write_text("a: b")
    S.update_run_log(spark, str(root), out, check)
    first = [("r1", "metrics", "auroc", 1700000000, 0.75, None, 0), ("r1", "metrics", "auroc", 1700000001, 0.8, None, 1),
             ("r1", "params", "lr", None, None, "0.1\nsecond line", None)]
    assert table(spark, out) == sorted(first, key=str)
    S.update_run_log(spark, str(root), out, check)                        # nothing new
    assert table(spark, out) == sorted(first, key=str)
    put(root, "0", "r2", "tags", "who", "me")
    put(root, "1", "r1", "metrics", "auroc", "1700000009 0.99 1\n1700000010 0.9 2\n\nbad line\n")       # r1 retried in another experiment
    for _ in range(2):
        S.update_run_log(spark, str(root), out, check, files_per_batch=1)
    more = [("r2", "tags", "who", None, None, "me", None), ("r1", "metrics", "auroc", 1700000010, 0.9, None, 2), ("r1", "metrics", "auroc", None, None, None, None)]
    assert table(spark, out) == sorted(first + more, key=str)


def test_a_logged_run_replaces_itself(spark, tmp_path):
    rows = [(f"r{i % 7}", f"m{i}", float(i)) for i in range(40)] + [(None, "m", 1.0)]
    df = spark.createDataFrame(rows, "run_id string, metric string, value double")
    for part in (df.where("metric < 'm2'"), df, df, df.where("run_id = 'r3'"), df.where("run_id is null")):
        path = S.sink_run_log(part, str(tmp_path), "metrics", buckets=3)
    got = spark.read.parquet(path)
    assert sorted((tuple(r) for r in got.select("run_id", "metric", "value").collect()), key=str) == sorted(rows, key=str)
    S.sink_run_log(spark.createDataFrame([("r3", "acc", 0.5, "new")], "run_id string, metric string, value double, note string"), str(tmp_path), "metrics", buckets=3)
    assert spark.read.option("mergeSchema", True).parquet(path).where("run_id = 'r3'").count() == 1


SHAPES = {
    "a": {"features": [{"name": "x", "mean_abs_impact": 0.5}, {"feature": "y", "importance": "0.7"}, {"name": "z", "mean_abs_impact": "bad"},
                       "text", 3, None, ["l"], {"name": None, "feature": "hidden", "importance": 1}, {"name": 7, "mean_abs_impact": 1}]},
    "b": [{"name": "w", "mean_abs_impact": 0.1}, 5],
    "c": {"features": [], "top_features": [{"column": "q", "mean_abs": 2}, {"mean_abs": 1}]},
    "d": {"features": {"name": "an object"}, "top_features": None},
    "e": {"features": None, "top_features": [{"name": {"nested": [1, {"deep": 2}]}, "importance": 4}, {"name": "n", "mean_abs_impact": [1]}]},
    "f": "just text", "g": 12, "h": {"other": {"features": [{"name": "inner", "mean_abs_impact": 1}]}},
}


def test_json_of_every_shape(spark, tmp_path):
    for k, v in SHAPES.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    (tmp_path / "broken.json").write_text('{"features": [')
    (tmp_path / "empty.json").write_text("")
    def got(f):
        return {(r.path[-6], r.name, r.mean_abs_impact) for r in f(spark, str(tmp_path)).collect()}
    plain = {("a", "x", 0.5), ("a", "y", 0.7), ("a", "7", 1.0), ("b", "w", 0.1)}
    nested = {x for x in got(A.normalize_features) if x[0] == "e"}
    assert got(A.normalize_features) - nested == plain and len(nested) <= 1       # a nested name is its JSON text, or no name
    assert got(A.normalize_features_alt) - nested == plain | {("c", "q", 2.0)}
    plan = A.normalize_features(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_reports_keep_what_can_be_read(spark, tmp_path):
    docs = {"a": {"auroc": 0.8, "n": 5, "tags": ["x", "y"], "sub": {"k": 1}}, "b": {"auroc": "high", "n": 7}, "c": [1, 2], "d": {"auroc": 1, "extra": {}}}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=2))
    (tmp_path / "e.json").write_text("{not json")
    rows = {r.path[-6]: r for r in S.scan_json_report(spark, str(tmp_path), "auroc double, n int, tags array<string>, sub struct<k:int>").collect()}
    assert (rows["a"].auroc, rows["a"].n, rows["a"].tags, rows["a"].sub.k) == (0.8, 5, ["x", "y"], 1)
    assert (rows["b"].auroc, rows["b"].n) == (None, 7) and rows["c"].auroc is None and rows["d"].auroc == 1.0
    assert rows["e"]._corrupt == "{not json" and all(rows[k]._corrupt is None for k in docs)


def test_manifest_names_inputs_outputs_and_hashes(spark, tmp_path):
    import hashlib
    (tmp_path / "in.csv").write_text("subject_id,a\n1,2\n")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0)], "subject_id int, a double")
    bp, cp, scaler, bi, ci = P.prepare_pair(b, b, P.PrepConfig(outliers="none"))
    out = S.sink_table(bp, str(tmp_path / "out"))
    path = S.sink_prep_manifest(spark, str(tmp_path / "m"), {"x": 1}, scaler.to_dataframe(spark), {"baseline": bp}, {("baseline", "post"): bi["post_stats"]()},
                                inputs={"baseline": str(tmp_path / "in.csv")}, output_paths={"baseline": out}, provenance={"job": "nightly"})
    doc = json.loads(spark.read.text(f"{path}/config").first()["value"])
    assert doc["inputs"] == {"baseline": str(tmp_path / "in.csv")} and doc["outputs"] == {"baseline": out} and doc["provenance"] == {"job": "nightly"}
    assert doc["created_at"].endswith("Z") and len(doc["created_at"]) == 20
    files = {(r.role, r.file): r for r in spark.read.json(f"{path}/files").collect()}
    assert files["input", "in.csv"].sha256 == hashlib.sha256((tmp_path / "in.csv").read_bytes()).hexdigest()
    parts = {p.name: p for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet"}
    assert {f for role, f in files if role == "output"} == set(parts)
    assert all(files["output", n].sha256 == hashlib.sha256(p.read_bytes()).hexdigest() for n, p in parts.items())
