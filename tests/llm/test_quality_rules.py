"""Quality rules against a plain version, the SQL twin, held-out labels and odd rows."""
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import quality_rules as Q
from modelwatch.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, score string, raw long, target long, bucket long, kept string, _good string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    seen = Counter(runs)
    hit = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + window)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def plain_grams(text, bits):
    hashes = []
    for w in WORD.findall(text or ""):
        h = 0
        for b in w.encode():
            h = (h * Q.BASE + b + 1) % (1 << 64)
        hashes.append(h)
    every = hashes + [(a * Q.PAIR + b) % (1 << 64) for a, b in zip(hashes, hashes[1:])]
    return [((h ^ (h >> 32)) * Q.SPREAD % (1 << 64)) >> (64 - bits) for h in every]


def plain_rules(rows, trusted, bits, alpha=1.0):
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(plain_grams(t, bits))
        if d in trusted and zlib.crc32(str(d).encode()) % Q.FOLDS:
            target.update(plain_grams(t, bits))
    n, m, size = sum(target.values()), sum(raw.values()), alpha * (1 << bits)
    x = {b: (math.log((target[b] + alpha) / (n + size)) - math.log((raw[b] + alpha) / (m + size)) if n else 0.0) for b in raw}
    out, apart = [], []
    for d, t in rows:
        c, g = plain_counts(t), plain_grams(t, bits)
        score = sum(map(x.get, g)) / len(g) if g else 0.0
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((d, *c, failed, score))
        if d in trusted and not failed and not zlib.crc32(str(d).encode()) % Q.FOLDS:
            apart.append(score)
    apart.sort()
    at = Q.LOWEST * (len(apart) - 1) if apart else 0
    cut = apart[int(at)] + (apart[min(int(at) + 1, len(apart) - 1)] - apart[int(at)]) * (at % 1) - Q.MARGIN if apart and n else -math.inf
    return Counter((*r[:7], not r[6] and r[7] >= cut, round(r[7], 9)) for r in out)


def check(spark, rows, trusted, bits=10):
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3, "y", "z") for d, t in rows], KIND)
    ids = spark.createDataFrame([(d,) for d in trusted], "doc_id long")
    got = Q.quality_rules(df, ids, bits=bits).collect()
    assert Counter((*r[:8], round(r.score, 9) + 0.0) for r in got) == Counter({(*k[:8], k[8] + 0.0): n for k, n in plain_rules(rows, set(trusted), bits).items()})
    return got


def texts(n, seed=1):
    rng = random.Random(seed)
    good, bad = [f"w{i}" for i in range(60)], [f"x{i}&&&" for i in range(60)]
    return [(i, rng.choice(" \n").join(rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randrange(15, 120)))) for i in range(n)]


ODD = [(900, None), (901, ""), (None, "no id " * 20), (902, "é漢 😀\x1c\x85 " * 30), (903, "same line\n" * 30 + "\n \n"), (904, "a b c d e f g h " * 5_000),
       (905, "x" * 100_000), (906, " \t\r\n"), (907, "tie " * 25), (907, "tie " * 25), (908, "one two three four five six seven eight nine")]


def test_matches_plain_version(spark):
    rows = texts(120) + ODD
    trusted = [d for d, _ in texts(120) if d % 5 and d % 3] + [902, 902, 99_999]
    got = check(spark, rows, trusted)
    assert {(r.base_failed, r.kept) for r in got} == {(True, False), (False, True), (False, False)}
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 and not r.base_failed)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0)


@pytest.mark.parametrize("trusted", [[], [99_999], [900, 901]])
def test_nothing_trusted(spark, trusted):
    got = check(spark, ODD + texts(10), trusted)
    assert all(r.kept != r.base_failed for r in got) or trusted == [900, 901]


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert Q.quality_rules(empty, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


@pytest.mark.parametrize("most", [Q.BROADCAST_IDS, 10])
def test_every_trusted_document_counts(spark, monkeypatch, most):
    """More trusted ids than were read once, and more than are broadcast."""
    monkeypatch.setattr(Q, "BROADCAST_IDS", most)
    rows = texts(300)
    got = Q.quality_rules(spark.createDataFrame(rows + ODD, "doc_id long, text string"), spark.range(260_000).select(F.col("id").alias("doc_id")).where("doc_id % 7 != 0"), bits=10)
    want = plain_rules(rows + ODD, {d for d in range(1_000) if d % 7}, 10)
    assert Counter((*r[:8], round(r.score, 9) + 0.0) for r in got.collect()) == Counter({(*k[:8], k[8] + 0.0): n for k, n in want.items()})


@pytest.mark.parametrize("n", [0, 1, 2, 201, 999])
def test_quantile(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([(rng.choice([rng.random(), 0.25]),) for _ in range(n)], "x double").repartition(5)
    for share in (0.0, Q.LOWEST, 0.5, 1.0):
        assert Q.quantile(df, "x", share) == df.agg(F.percentile("x", share)).first()[0]


def test_repeated_windows(spark):
    rng = random.Random(2)
    powers = Q.Powers()
    rows = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    words = powers.words([r.encode() for r in rows])
    for k in (1, 2, 3, 8):
        assert words.repeat_words(k).tolist() == [plain_counts(r, k)[4] for r in rows]


def test_held_out_labels(spark):
    """The verdict on labelled rows that the operator has not seen as trusted and the base rules pass."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = {d for d in quality if zlib.crc32(str(d).encode()) % 4 == 2}
    ids = spark.createDataFrame([(d,) for d, q in quality.items() if q == 1 and d not in held], "doc_id long")
    got = {r.doc_id: r.kept for r in Q.quality_rules(docs, ids).collect() if not r.base_failed}
    good, bad = ([got[d] for d in held if quality[d] == q and d in got] for q in (1, 0))
    assert len(good) > 60 and sum(good) >= 0.98 * len(good)
    assert len(bad) >= 8 and sum(bad) <= 0.15 * len(bad)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES["op12_quality_rules"](spark, SF)
    want = con.sql(ORACLE["op12_quality_rules"])
    assert got.columns == want.columns
    def near(rows):
        return Counter((*r[:-1], round(r[-1], 5) + 0.0) for r in map(tuple, rows))
    assert near(got.collect()) == near(want.fetchall())
