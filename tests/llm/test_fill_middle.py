"""Fill-in-the-middle against a plain version, the SQL twin, round trips and odd rows."""
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from modelwatch.llm import fill_middle as FM
from modelwatch.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, n string, form string, output string, _text long, restored string"


def plain_version(doc_id, text, plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y", "z", 1, "w") for d, t in rows], KIND)
    out = FM.restore(FM.fill_in_middle(df, **options)).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored, r.restored_sha256) for r in out)
    want = Counter()
    for d, t in rows:
        x = plain_version(d, t, options.get("plain_percent", 10), options.get("spm_percent", 20))
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (x[4], t or "")]
        want[(d, *x, sha[0], t or "", sha[1])] += 1
    assert got == want
    return {r.form for r in out}


ODD = [(1, None), (2, ""), (None, "no id"), (3, "a"), (3, "a"), (4, "<P> stays"), (5, "tail <P"), (6, "<<S<M"), (7, "é漢字😀ab\nc\x00\t"), (8, "́x" * 3),
       (9, "word " * 40_000), (10, "Z" * 200_000), (11, ">>>"), (12, "<M>")]


@pytest.mark.parametrize("plain,spm", [(10, 20), (0, 0), (0, 100), (100, 0)])
def test_odd_rows(spark, plain, spm):
    forms = check(spark, ODD + [(100 + i, t) for i, (_, t) in enumerate(ODD)], plain_percent=plain, spm_percent=spm)
    assert forms <= {"plain", "psm", "spm"} and ("spm" in forms) == (spm > 0)


def test_random_texts(spark):
    rng = random.Random(4)
    check(spark, [(i, "".join(rng.choice("ab<>PSM é漢😀\n") for _ in range(rng.randrange(60)))) for i in range(600)], plain_percent=5)


def test_batches_are_cut_by_bytes(spark):
    off = np.array([0, 3, 3, 10, 30, 31, 31])
    for size in (1, 4, 12, 100):
        cuts = list(FM.byte_chunks(off, size))
        assert [lo for lo, _ in cuts] == [0] + [hi for _, hi in cuts[:-1]] and cuts[-1][1] == 6
    assert list(FM.byte_chunks(off[:1], 4)) == []


def test_empty_table(spark):
    assert FM.restore(FM.fill_in_middle(spark.createDataFrame([], KIND))).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op13_fill_in_middle"](spark, SF)
    want = con.sql(ORACLE["op13_fill_in_middle"])
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
