"""File digests by byte ranges, hash trees, file states, and the bounded history table."""
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import evidence as E
from modelwatch.operators import history as H
from modelwatch.sources import byte_ranges as B


def write(path, data):
    path.write_bytes(data)
    return str(path)


def tree(data, block, fan):
    level = [hashlib.sha256(data[i:i + block]).hexdigest() for i in range(0, max(len(data), 1), block)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_file_digests(spark, tmp_path):
    rng = random.Random(1)
    data = {f"f{n}.bin": rng.randbytes(n) for n in (0, 1, 4095, 4096, 4097, 50_000)} | {"odd name %20é.bin": b"x"}
    for name, content in data.items():
        write(tmp_path / name, content)
    (tmp_path / "folder.bin").mkdir()
    for uri in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        rows = {r.name: r for r in E.file_digest(spark, [f"{uri}/*.bin", f"{uri}/none.txt"]).collect()}
        assert {n: (r.size_bytes, r.sha256) for n, r in rows.items() if r.exists} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
        assert not rows["none.txt"].exists and rows["f1.bin"].mtime_iso.endswith("Z")
        assert rows["f1.bin"].mtime_epoch == int(os.stat(tmp_path / "f1.bin").st_mtime)
    for block, fan, part in ((4096, 2, 4096), (1000, 3, 7000), (64, 1024, 1 << 20)):
        got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.n_blocks, r.tree_sha256) for r in
               E.tree_digest(spark, str(tmp_path / "f*.bin"), block, fan, part).collect()}
        assert got == {n: (len(c), max(1, -(-len(c) // block)), tree(c, block, fan)) for n, c in data.items() if n != "odd name %20é.bin"}


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """Sparse, so it takes no room; the hash is of all its zeros."""
    path, size = tmp_path / "large.bin", (2 << 30) + (1 << 20) + 7
    with open(path, "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    want.update(bytes(size & ((1 << 20) - 1)))
    row = E.file_digest(spark, str(path)).first()
    assert (row.size_bytes, row.sha256) == (size, want.hexdigest())
    blocks = E.byte_ranges(spark, [str(path)], block_bytes=256 << 20, partition_bytes=512 << 20)
    assert blocks.rdd.getNumPartitions() == 5 and blocks.agg(F.sum("length"), F.count("*")).first() == (size, 9)


def test_ranges_are_planned_by_bytes():
    files = [("a", 10, None), ("b", 0, None), ("c", 100, None), ("d", 3, None)]
    parts = [[(p, lo, hi) for p, _, _, lo, hi in r.ranges] for r in B.plan(files, 0, 20)]
    assert parts == [[("a", 0, 10), ("b", 0, 0)], [("c", 0, 100)], [("d", 0, 3)]]
    parts = [[(p, lo, hi) for p, _, _, lo, hi in r.ranges] for r in B.plan(files, 8, 32)]
    assert parts == [[("a", 0, 10), ("b", 0, 0)], [("c", 0, 32)], [("c", 32, 64)], [("c", 64, 96)], [("c", 96, 100), ("d", 0, 3)]]
    assert B.plan([], 0, 20) == []


def test_a_file_that_shrank_is_an_error(tmp_path):
    with open(write(tmp_path / "f", b"abc"), "rb") as f, pytest.raises(OSError):
        B.hashed(f, 0, 5)


def test_file_states(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", (F.col("id") % 4).alias("k"), F.lit(None).cast("string").alias("s"))
    df.where("k < 3").repartition("k").write.partitionBy("k").parquet(path)
    before = E.file_state(spark, path)
    assert E.state_of(before).first() == E.table_fingerprint(spark.read.parquet(path)).first()
    before = spark.createDataFrame(before.collect(), before.schema)
    df.where("k = 3").write.mode("append").partitionBy("k").parquet(path)                          # a file more
    (df.where("k = 1 and id > 50").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(path))
    E.remove(spark, f"{path}/k=2")
    after = E.file_state(spark, path, known=before)
    assert E.state_of(after).first() == E.table_fingerprint(spark.read.parquet(path)).first()
    changes = {(r.change, r.file.split("k=")[1][0]) for r in E.compare_states(before, after).collect()}
    assert changes == {("added", "3"), ("added", "1"), ("removed", "1"), ("removed", "2")}
    # Only new files are read: what is known of a file of the same version is taken over.
    known = spark.createDataFrame(after.collect(), after.schema)
    told = known.withColumn("fingerprint", F.when(F.col("file").contains("k=0"), "7").otherwise(F.col("fingerprint")))
    assert {r.fingerprint for r in E.file_state(spark, path, known=told).where("file like '%k=0%'").collect()} == {"7"}
    same = E.compare_states(known, known)
    assert same.count() == 0
    moved = known.withColumn("modified", F.col("modified") + F.expr("interval 1 hour"))
    assert {r.change for r in E.compare_states(known, moved).collect()} == {"rewritten"}
    other = known.withColumn("fingerprint", F.lit("1"))
    assert {r.change for r in E.compare_states(known, other).collect()} == {"changed"}


def test_a_year_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """All rows of one year: the query's tasks sort and write parts of a size, not a year each."""
    from modelwatch.plans import registry as R
    ids = spark.range(40_000).repartition(8)
    year = F.when(F.col("id") % 100 == 0, F.lit(1995) + F.col("id") / 100 % 3).otherwise(F.lit(1999)).cast("int")
    li = ids.select(*[(F.xxhash64("id", F.lit(c)) % 1000).alias(c) for c in R.ST.LINEITEM_ALL if c not in ("l_shipdate", "l_linenumber")],
                    (F.col("id") % 7).alias("l_linenumber"), F.make_date(year, F.lit(3), F.lit(1)).cast("timestamp_ntz").alias("l_shipdate"))
    li.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    places = iter(range(9))
    monkeypatch.setattr(R, "_scratch", lambda spark, name: str(tmp_path / f"{name}{next(places)}"))
    set_to, name = "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, set_to)
    try:
        rows = {r.yr: r for r in R.QUERIES["file_state"](spark, str(tmp_path / "sf")).collect()}
    finally:
        spark.conf.unset(name)
    assert {y: r.change for y, r in rows.items()} == {1995: "removed", 1996: "changed", 1997: "added", 1999: None}
    want = E.table_fingerprint(li.where("year(l_shipdate) = 1999"), R.ST.LINEITEM_ALL).first()
    assert (rows[1999].rows, rows[1999].fingerprint) == tuple(want) and want.rows == 39_600
    assert len(list((tmp_path / "lineitem0" / "yr=1999").glob("*.parquet"))) > 1


def test_sums_of_row_hashes(spark):
    """Sums beyond a LONG are exact, and no long decimal is added up row by row."""
    rng, top = random.Random(3), (1 << 60) - 1
    for values in ([], [0], [top] * 300, [rng.randrange(1 << 60) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in values], "h long")
        assert df.agg(E.hash_sum("h").cast("string")).first()[0] == (str(sum(values)) if values else None)
    plan = E.table_fingerprint(spark.range(5))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(" not in plan.lower() and plan.count("conv(") == 1


HIST = "model string, run_id long, ts long, status string"


def stored(spark, path):
    return sorted(map(tuple, H.read_history(spark, path).select("model", "run_id", "ts", "status").collect()))


def test_history_is_bounded_and_idempotent(spark, tmp_path):
    path, rng = str(tmp_path / "h"), random.Random(5)
    rows = [(f"m{rng.randrange(3)}", i, rng.randrange(400), rng.choice(["PASS", "FAIL"])) for i in range(300)] + [("hot", 1000 + i, i % 50, "PASS") for i in range(250)]
    def newest(rows):
        out = []
        for m in {r[0] for r in rows}:
            out += sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1]), reverse=True)[:20]
        return sorted(out)
    seen = []
    for lo in range(0, len(rows), 110):
        batch = rows[lo:lo + 110]
        seen += batch
        for _ in range(2):                                  # each batch arrives twice
            H.append_history(spark.createDataFrame(batch, HIST), path, keep=20, buckets=4)
            assert stored(spark, path) == newest(seen)
    H.append_history(spark.createDataFrame(rows[:40], HIST), path, keep=20, buckets=4)      # an early batch is replayed late
    assert stored(spark, path) == newest(rows)
    H.append_history(spark.createDataFrame([], HIST), path, keep=20, buckets=4)
    assert stored(spark, path) == newest(rows)


def test_history_records_that_come_again(spark, tmp_path):
    path = str(tmp_path / "h")
    H.append_history(spark.createDataFrame([("a", 1, 5, "PASS"), ("a", 1, 5, "FAIL"), (None, 2, 1, "PASS")], HIST), path)
    assert H.read_history(spark, path).count() == 2
    H.append_history(spark.createDataFrame([("a", 1, 9, "FAIL", "new")], HIST + ", note string"), path)
    got = {(r.model, r.ts, r.status) for r in H.read_history(spark, path).collect()}
    assert ("a", 9, "FAIL") in got and (None, 1, "PASS") in got and len(got) == 2


def test_history_from_a_stream(spark, tmp_path):
    """Files in micro-batches, then the same stream from the start once more with a new checkpoint."""
    rows = [("m", i, i, "PASS") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k:20 * k + 20], HIST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for turn in range(2):
        stream = spark.readStream.schema(HIST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda df, _: H.append_history(df, str(tmp_path / "h"), keep=25)).option(
            "checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert stored(spark, str(tmp_path / "h")) == rows[35:]
