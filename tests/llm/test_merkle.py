"""The Merkle manifest against a plain version, the SQL twin, tampering and odd rows."""
import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import merkle as M
from modelwatch.llm.common import crc32_sql
from modelwatch.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, n long, digest string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fan):
    """(top, [(left, right), ...] of every leaf from its own level upwards)."""
    proofs, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for p, at in zip(proofs, place):
            run, k = runs[at // fan], at % fan
            p.append(("".join(run[:k]), "".join(run[k + 1:])))
        place, level = [at // fan for at in place], [sha(*r) for r in runs]
    return level[0], proofs


def plain_manifest(rows, fan):
    groups = defaultdict(list)
    for r in rows:
        fields = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r]
        groups[r[1]].append(((r[0] is not None, r[0] or 0), sha(*fields), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = plain_tree([leaf for _, leaf, _ in groups[g]], fan)
    root, above = plain_tree([trees[g][0] for g in order], fan)
    return Counter((r[0], g, leaf, trees[g][0], root, tuple(p + up))
                   for g, up in zip(order, above) for (_, leaf, r), p in zip(groups[g], trees[g][1]))


def check(spark, rows, fan):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], KIND)
    out = M.merkle_manifest(df, fan=fan)
    out = out.withColumn("back", M.fold(F.col("leaf"), F.col("proof"))).withColumn("named", M.proof_digest(F.col("proof"))).collect()
    assert all(r.back == r.root and r.named == sha(*[x for s in r.proof for x in s]) for r in out)
    assert Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in out) == plain_manifest(rows, fan)


def of(source, n, at=0):
    return [(at + i, source, "en", i, f"text {i} of {source}") for i in range(n)]


@pytest.mark.parametrize("fan", [2, 16])
def test_groups_of_many_sizes(spark, fan):
    rows = [r for i, n in enumerate((1, 2, 3, 4, 5, 16, 17, 40)) for r in of(f"s{i}", n, 1000 * i)]
    check(spark, rows + of(None, 7, 90_000), fan)


def test_one_hot_group_and_many_lone_ones(spark):
    check(spark, of("hot", 300) + [(5000 + i, f"lone{i}é"[:i % 9 + 2], None, None, None) for i in range(60)], 16)
    check(spark, [(i, f"s{i:03d}", "en", i, "t") for i in range(300)], 16)        # the upper tree has three levels


def test_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "de", 0, ""), (2, "é", "é", 1, "日本 " * 50_000), (None, "a", "b", -1, "-")]
    check(spark, odd, 2)
    check(spark, odd[:1], 16)
    assert M.merkle_manifest(spark.createDataFrame([], KIND)).count() == 0


def test_tampering_shows_where_it_is(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in of("a", 40) + of("b", 3, 100)], KIND)
    changed = M.leaf_digest(*[F.concat("text", F.lit(".")) if c == "text" else F.col(c) for c in M.FIELDS])
    out = M.merkle_manifest(df, keep={"claim": F.when(F.col("doc_id") % 7 == 0, changed)})
    bad = out.where(M.fold(F.coalesce("claim", "leaf"), F.col("proof")) != F.col("root")).select("doc_id").collect()
    assert {r.doc_id for r in bad} == {d for d in [*range(40), 100, 101, 102] if d % 7 == 0}


def test_query_matches_sql(spark):
    import zlib
    con = duckdb.connect()
    for d in (0, 7, 12345, 999999999999):
        assert con.sql(f"SELECT {crc32_sql(repr(str(d)))}").fetchall()[0][0] == zlib.crc32(str(d).encode())
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op11_merkle_manifest"](spark, SF)
    want = con.sql(ORACLE["op11_merkle_manifest"])
    assert got.columns == want.columns
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(want.fetchall()) and {r[-1] for r in rows} == {True, False}
