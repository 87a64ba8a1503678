"""The pipeline's stages, one after the other, against plain versions of what each must keep."""
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import duckdb
import public_tokenizers
import pytest

from modelwatch.llm import common, decontaminate, line_templates

from .test_operators import bits, close_components

SF = "/root/testdata/sf0.001"


def grams(text):
    """3-grams of letter runs with one edge on either side, the middle one a letter, two letters at least."""
    out = []
    s = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    for a, b, c in zip(s, s[1:], s[2:]):
        if b != "\0" and (a != "\0" or c != "\0"):
            out.append((a, b, c))
    return out


def plain_language(rows):
    """Ids kept: the best language knows 0.3 of the n-grams, or there are fewer than 20 (and a letter)."""
    n = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None:
            n[r.lang].update(grams(r.text))
    share = {x: {g: k / sum(c.values()) for g, k in c.items()} for x, c in n.items()}
    top = Counter()
    for c in share.values():
        for g, p in c.items():
            top[g] = max(top[g], p)
    known = {x: {g for g, p in c.items() if p >= 0.5 * top[g] and p >= 1e-5} for x, c in share.items()}
    kept = set()
    for r in rows:
        own = grams(r.text or "")
        if not own and not any(map(str.isalpha, r.text or "")):
            continue
        best = max(sum(g in k for g in own) for k in known.values()) / max(1, len(own))
        if best >= 0.3 or len(own) < 20:
            kept.add(r.doc_id)
    return kept


def plain_lines(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in rows])
    return {r[0]: r[3] for r in con.sql(line_templates.strip_templates_sql()).fetchall()}


def plain_near_dedup(rows):
    fps = [bits(r.text, 3) for r in rows]
    root = close_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    low = {}
    for r, k in zip(rows, root):
        low[k] = min(low.get(k, r.doc_id), r.doc_id)
    return set(low.values())


def plain_clean(rows, items):
    kept = set()
    words = [re.findall(r"\w+", t.lower()) for t in items if t]
    shingles = [Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) for w in words for k in [min(5, len(w))] if w]
    for r in rows:
        h, bad = re.findall(r"\w+", (r.text or "").lower()), False
        for c in shingles:
            k, n = len(next(iter(c))), sum(c.values())
            s = [tuple(h[j:j + k]) for j in range(len(h) - k + 1)]
            m = min(n, len(s))
            near = {a for j, x in enumerate(s) if x in c for a in range(max(0, j - m + 1), min(j, len(s) - m) + 1)}
            bad = bad or any(decontaminate.weighted_jaccard(Counter(s[a:a + m]), c) >= 0.8 for a in near)
        if not bad:
            kept.add(r.doc_id)
    return kept


def test_stages(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_codec"]
    for name, stage in P.STAGES:
        before = docs.collect()
        out = common.save(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "language_id":
            assert set(after) == plain_language(before)
        elif name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == plain_lines(before)
            assert all(r.n_chars == len(r.text) for d, r in after.items() if r.text != {x.doc_id: x.text for x in before}[d])
        elif name == "simhash_near_dedup":
            assert set(after) == plain_near_dedup(before) and len(after) < len(before)
        elif name == "benchmark_decontamination":
            assert set(after) == plain_clean(before, items) and len(after) < len(before)
        else:
            assert {d: r.ids for d, r in after.items()} == {r.doc_id: sp.encode(r.text) for r in before}
            assert all(r.round_trip for r in after.values())
        if name != "sentencepiece_codec":
            assert out.schema.names == docs.schema.names
        docs = out


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_documents(spark):
    body = "The quick brown fox jumps over the lazy dog and runs away into the deep green forest.\n"
    rows = [(1, body, "en", "a", 90), (1, body, "en", "a", 90), (2, body, None, None, None), (None, "Some words without an id.", "en", "a", 5),
            (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, "12 34 !!", "en", "a", 8)]
    docs = spark.createDataFrame(rows, KIND)
    for name, stage in P.STAGES:
        docs = common.save(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} == {1, 2, None}      # 2 lost its line to 1; 3, 4 and 5 hold no language
    empty = spark.createDataFrame([], KIND)
    for name, stage in P.STAGES:
        empty = common.save(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_two_texts_under_one_id(spark):
    """The copy under id 5 goes with its group, the other text of id 5 stays, whatever its hash."""
    for k in range(6):
        copy, own = "one two three four five six seven", f"quite different words number{k} of another document"
        docs = spark.createDataFrame([(3, copy, "en", "a", 1), (5, copy, "en", "a", 1), (5, own, "en", "a", 1)], KIND).withColumnsRenamed({"source": "n", "lang": "row"})
        out = P.near_dedup_stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(3, copy), (5, own)]


@pytest.mark.parametrize("text,kept", [("ab cd", True), ("q9 " * 40 + "xqz vwk jqx zzx " * 20, False), ("1234 !!", False)])
def test_accepted_languages(spark, text, kept):
    from modelwatch.llm import language_id
    docs = spark.createDataFrame([(i, "the old man and the sea went out to fish in the morning", "en") for i in range(5)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(9, text, None)], docs.schema)
    assert (language_id.accepted(asked, language_id.fit(docs)).count() == 1) == kept
