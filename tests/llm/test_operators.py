"""The text operators against brute force, libraries, held-out labels and odd rows."""
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from modelwatch.llm import decontaminate as DC
from modelwatch.llm import embedding_dedup, language_id, line_templates, lm_score, piece_codec, quality
from modelwatch.llm import simhash_dedup, token_counts, toxicity
from modelwatch.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "en"), (None, "no id here at all", "en"), (4, "x " * 30_000, "en"), (5, "tie tie tie", "en"),
       (5, "tie tie tie", "en"), (6, " \t\n ", "fr"), (7, "été <|endoftext|> ▁ 漢字 \x1c 1234", None)]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'a' AS h", "1 AS score", "2 AS fp", "3 AS n_lines")


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def close_components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def bits(text, k):
    w = text.encode().lower().split()
    s = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).collect()]
    got = {r.doc_id: r for r in QUERIES["op2_simhash_dedup"](spark, SF).collect()}
    fps = [bits(t, 3) for _, t in rows]
    root = close_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    low = defaultdict(lambda: 1 << 60)
    for (d, _), r in zip(rows, root):
        low[r] = min(low[r], d)
    assert {d: (f"{f:016x}", low[r]) for (d, _), f, r in zip(rows, fps, root)} == {d: (r.fingerprint, r.component_id) for d, r in got.items()}


def test_vantage_shards_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
                      for _ in range(3)]
    fps = np.unique(np.concatenate(flips))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash_dedup.link_fingerprints(df, radius=2, sample=200, shard_rows=100).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = close_components(len(fps), lambda i, j: d[i, j] <= 2)
    got = {(place[r.u], place[r.v]) for r in links}
    assert close_components(len(fps), lambda i, j: (i, j) in got or (j, i) in got) == want


def test_embedding_groups_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = QUERIES["op5_embedding_dedup"](spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(ORACLE["op5_embedding_dedup"]).fetchall())


def test_embedding_cells_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12))
    x = np.vstack([x + 0.15 * rng.normal(size=x.shape) for _ in range(4)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, float("nan")]), (1004, [1.0, 2.0]),
            (1005, [2.0, 4.0]), (1006, x[0].tolist()), (1007, [1e300] * 12), (1008, [1e-300] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df, 0.9, cell_rows=40, sample=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T >= 0.9)
    for i in range(1, len(x)):
        assert got[i].n_links == c[i].sum() - 1 + int(c[i, 0])       # 1006 repeats vector 0
    assert [got[i].n_links for i in (1000, 1001, 1002, 1003)] == [0] * 4
    assert got[1004].n_links == 1 and got[1005].component_id == 1004 and got[1008].component_id == 1007
    root = close_components(len(x), lambda i, j: c[i, j])
    assert all(got[i].component_id == root[i] for i in range(len(x)))


def test_pieces_match_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(r.doc_id, r.text) for r in docs_of(spark).collect()] + [(-1, "a  b   c\n\n\td"), (-2, "ab" * 80 + " " * 40), (-3, "日本 😀 ﬁ"), (-4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in piece_codec.piece_codes(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for d, t in rows:
        assert got[d].ids == sp.encode(t) and got[d].round_trip
        assert got[d].ids_crc32 == zlib.crc32(np.array(got[d].ids, dtype="<i4").tobytes())


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text) for r in docs_of(spark).collect()] + [(-1, "<|endoftext|>x <|startoftext|>"), (-2, "a\x1cb\x85c\xa0d İΣ é I'LL"), (-3, "")]
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"),
                                                          public_tokenizers.path("word_bpe_49k.json")).collect()}
    for d, t in rows:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 2048)


def test_language_held_out(spark):
    out = language_id.language_id(docs_of(spark, "/root/testdata/sf0.01")).join(docs_of(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


@pytest.mark.parametrize("run, label, least", [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.9)])
def test_classifiers_held_out(spark, run, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = run(docs_of(spark, sf), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r[label] == r.predicted for r in rows) >= least * len(rows)


def test_toxic_sentences_are_located(spark):
    bad = [(i, f"The day was fine number{i}. You are a total moron today! We went home.", 1) for i in range(40)]
    good = [(100 + i, f"The day was fine number{i}. You are a total friend today! We went home.", 0) for i in range(200)]
    df = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    for r in toxicity.toxicity(df.drop("toxic"), df.drop("text")).collect():
        if r.doc_id < 100:
            assert r.predicted == 1 and [x["index"] for x in r.offending] == [1]
            assert "moron" in dict((a, b) for a, b, _ in bad)[r.doc_id][r.offending[0]["start"]:r.offending[0]["end"]]
        else:
            assert r.predicted == 0 and not r.offending


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lm_scores_match_brute_force(spark, order):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).collect()] + [(9001, "one"), (9002, ""), (9003, "one two"), (9004, "never before seen it is the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, batch_tokens=5000, bucket_entries=3000, order=order).collect()}
    seq = {d: t.encode().lower().split() + ["end"] for d, t in rows}
    train = {d for d in seq if zlib.crc32(str(d).encode()) % 7 != 2}
    seen = Counter()
    for d in train:
        s = ["start"] + seq[d]
        seen.update(tuple(s[i:i + k]) for k in range(1, order + 1) for i in range(len(s) - k + 1) if k > 1 or i)
    seen["start",] = len(train)
    uni = {g[0]: c for g, c in seen.items() if len(g) == 1 and g[0] != "start"}
    n, v, k = sum(uni.values()), len(uni), lm_score.PRIOR

    def p(context, w):
        if not context:
            return (uni.get(w, 0) + 1) / (n + v + 1)
        return (seen[(*context, w)] + k * p(context[1:], w)) / (seen[context] + k)

    for d, s in seq.items():
        whole = ["start"] + s
        score = sum(np.log10(p(tuple(whole[max(0, i - order + 1):i]) if order > 1 else (), whole[i])) for i in range(1, len(whole)))
        base = sum(np.log10(p((), w)) for w in s)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(s), sum(uni.get(x, 0) > 0 for x in s), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 1e-6 * abs(score), d
    with pytest.raises(ValueError):
        lm_score.lm_scores(docs, order=0)


def test_lm_batches_send_no_more_rows_than_entries():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    for n in (1, 7, 500, 10 ** 9):
        bucket, edge = lm_score.buckets_of(h, n)
        assert len(bucket) <= len(h) and len(edge) == len(bucket) + 1 and edge[0] == 0 and edge[-1] == len(h) and (np.diff(bucket) > 0).all()
        assert all(((h[x:y] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32) == b).all() for b, x, y in zip(bucket, edge, edge[1:]))
    assert lm_score.buckets_of(h[:0], 5)[1].tolist() == [0]


def test_line_templates(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op9_line_templates"](spark, SF).select("doc_id", "n_lines", "n_dropped", "text")
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(ORACLE["op9_line_templates"]).fetchall())
    rows = [(1, "user 17 logged in from host7 at noon today ok\nown words of the first one"), (2, "user 99 logged in from host8 at noon today ok\nother words"),
            (3, "user 5 logged in from host9 at midnight today ok\nthird"), (None, "third")]
    got = {r.doc_id: r for r in line_templates.strip_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].text == "other words" and got[3].text == "third" and got[None].text == "third"


def rounds_by_hand(lines, docs=None, similarity=0.8, depth=3):
    """Template name of each different line, by the rounds that line_templates describes."""
    docs = docs or {x: {d} for d, x in enumerate(lines)}
    leaves, name = defaultdict(list), {x: x for x in lines}
    for x in lines:
        t = tuple(x.split(" "))
        if len(t) > depth:
            leaves[(len(t), t[:depth])].append(t)
    todo = [(f"leaf {k}", v) for k, v in leaves.items()]
    while todo:
        at, group = todo.pop()
        if len(group) < 2 or len(set().union(*[docs[" ".join(t)] for t in group])) < 2:
            continue
        cols = [Counter(col) for col in zip(*group)]
        vote = [max((n, x) for x, n in c.items())[1] for c in cols]
        fit = {t for t in group if sum(a == b for a, b in zip(t, vote)) >= similarity * len(t) and any(a == b != "<*>" for a, b in zip(t, vote))}
        name |= {" ".join(t): at for t in fit}
        if fit:
            todo.append((f"{at} rest", [t for t in group if t not in fit]))
            continue
        shared = [sum(n for n in c.values() if 1 < n < len(group)) for c in cols]
        if max(shared):
            pos, parts = shared.index(max(shared)), defaultdict(list)
            for t in group:
                parts[t[pos] if cols[pos][t[pos]] > 1 else None].append(t)
            todo += [(f"{at} part {pos} {k}", v) for k, v in parts.items()]
    return name


def test_line_templates_of_one_leaf(spark):
    """Several templates in one leaf: two by majority, then ones that no vote fits at once."""
    kind, rng = "doc_id long, text string", random.Random(9)
    two = [f"the service host {x} accepted a new login from outside" for x in ("alpha", "beta", "gamma")]
    two += [f"the service host {x} refused all old keys of guests" for x in ("delta", "omega")]
    got = line_templates.strip_templates(spark.createDataFrame(list(enumerate(two)), kind)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}
    word = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    lines = set()
    for size in (6, 10, 15):
        for _ in range(12):
            body = rng.choices(word, k=size)
            at = rng.randrange(size)
            lines |= {" ".join(["this is it", *body[:at], x, *body[at + 1:]]) for x in rng.choices(word, k=rng.randint(1, 5))}
        lines |= {" ".join(["this is it", *rng.choices(word[:20], k=size)]) for _ in range(10)}
    lines = sorted(lines)
    name, first = rounds_by_hand(lines), {}
    want = {d: int(first.setdefault(name[x], d) != d) for d, x in enumerate(lines)}
    assert len({n.split(" part ")[0] for n in name.values() if "part" in n}) == 3 and sum(want.values()) > 40
    assert any("rest" in n for n in name.values())
    got = line_templates.strip_templates(spark.createDataFrame(list(enumerate(lines)), kind)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == want


def test_lines_of_fields_only(spark):
    """Different numbers, dates and table rows stay; equal ones recur; no template without a constant token."""
    lines = ["42", "43", "12.5 7.1 9.0", "8.5 7.1 9.0", "1 2 3 4 5", "1 2 3 4 6", "2021-01-02", "42", "12.5\t7.1  9.0", "<*> 42", "<*> 43",
             "7 8 9 10 some", "7 8 9 10 other", "page 4 of 9", "page 5 of 9", "9 " * 20_000, "8 " * 20_000]
    got = line_templates.strip_templates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {7, 8, 14}


LINES = ["42", "43", "12.5 7.1 9.0", "8.5 7.1 9.0", "the cat sat on the mat now", "the cat sat on a mat now", "the cat sat by a rug now",
         "the dog 12 ran on a rug then", "the dog 13 ran on a rug then", "<*> <*> <*> <*> word 1 2", "<*> <*> <*> <*> other 1 2", " \t", "",
         "a\x0bb", "x y z é 漢字 ok", "x y z é 漢 ok"]


@pytest.mark.parametrize("seed", range(2))
def test_line_templates_match_sql_on_mixed_lines(spark, seed):
    """Leaves with several rounds, lines of fields, groups of one document, ties, against the SQL."""
    rng = random.Random(seed)
    rows = []
    for d in range(60):
        body = [rng.choice(LINES) for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(6)):
            lead, rest = rng.choice(["we go home", "they stay put"]), [rng.choice("pqrs") + rng.choice("xy") for _ in range(6)]
            body.append(" ".join([lead, *rest]))
        rows.append((d, "\n".join(body)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = line_templates.strip_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert got == Counter(con.sql(line_templates.strip_templates_sql()).fetchall())


def test_line_templates_keep_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b c d\nown", 7, "p", 1, 2, 3, 4), (2, "a b c d\nmine", 8, "q", 5, 6, 7, 8)],
                               "doc_id long, text string, n_lines int, `_th` string, gone int, row int, th int, `a.b` int")
    out = line_templates.strip_templates(df)
    assert out.columns == ["doc_id", "text", "_th", "gone", "row", "th", "a.b", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d\nown", "p", 1, 2, 3, 4, 2, 0), (2, "mine", "q", 5, 6, 7, 8, 2, 1)]


def test_line_templates_run_no_python(spark):
    plan = line_templates.strip_templates(docs_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(word, k=rng.choice([3, 12, 40, 60])))) for i in range(40)]
    rows = []
    for d in range(60):
        w = rng.choices(word, k=80)
        own = items[d % 40][1].split()
        if d % 3 == 0:
            own[rng.randrange(len(own))] = "changed"
        if d % 4:
            at = rng.randrange(60)
            w[at:at] = own
        rows.append((d, " ".join(w).title() + "."))
    rows.append((100, items[3][1]))
    got = {r.doc_id: r for r in DC.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                         spark.createDataFrame(items, "item_id long, text string"), block_items=16).collect()}
    for d, t in rows:
        h, want = DC.WORD(t.lower()), []
        for i, x in items:
            x = DC.WORD(x)
            k = min(5, len(x))
            c = Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
            s = [tuple(h[j:j + k]) for j in range(len(h) - k + 1)]
            m = min(len(x) - k + 1, len(s))
            if m > 0 and any(DC.weighted_jaccard(Counter(s[a:a + m]), c) >= 0.8 for a in range(len(s) - m + 1)):
                want.append(i)
        assert got[d].item_ids == want and got[d].contaminated == bool(want)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    """Nulls, empty and long texts, repeats, clashing extra columns, empty tables."""
    docs, n = odd(spark, rows), len(rows)
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 1), (2, None, None)] if rows else [], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "tie tie tie"), (3, "tie tie tie"), (4, "")], "item_id long, text string")
    path = public_tokenizers.path
    fp = simhash_dedup.simhash_groups(docs).collect()
    assert len(fp) == n
    und = language_id.language_id(docs).collect()
    assert len(und) == n and all(r.lang_pred == "und" and r.score == 0 for r in und if r.doc_id in (1, 2, 6))
    for out in (quality.quality(docs, labels), toxicity.toxicity(docs, labels), lm_score.lm_scores(docs),
                token_counts.token_counts(docs, path("word_bpe_49k.json")), piece_codec.piece_codes(docs, path("piece_bpe_32k.model")),
                line_templates.strip_templates(docs), DC.leaks(docs, items)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in rows)
    if rows:
        assert {r.component_id for r in fp if r.doc_id in (1, 2, 6)} == {1}
        assert [r.item_ids for r in DC.leaks(docs, items).where("doc_id = 5").collect()] == [[3], [3]]
        for block_items in (1, 100):      # an item without an id is found, but has no id to name
            bad = DC.leaks(docs, items.where("item_id is null or item_id <> 3"), block_items=block_items).where("contaminated").collect()
            assert [(r.doc_id, r.item_ids, r.similarity) for r in bad] == [(5, [], 1.0)] * 2


def test_bounded_samples_at_any_size(spark):
    from modelwatch.llm import common
    df = spark.range(100_000)
    assert 800 < common.bounded(df, "id", 1000).count() < 1200
    assert common.bounded(df, "id", 1000, total=10).count() == 100_000
    for most, total in ((20_000, 10 ** 15), (65_536, 10 ** 16)):       # far beyond what 20 bits of a slot can tell apart
        assert abs(int(most / total * common.SLOTS) / common.SLOTS * total - most) < 1e-3 * most
    assert df.where(common.slot_of("id") < 0).count() == 0 and df.where(common.slot_of("id") >= common.SLOTS).count() == 0


def test_odd_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_groups(empty).count() == 0


def test_decontamination_recall_near_the_threshold():
    """Planted near copies of similarity 0.8 and more: SimHash may miss few, and only close to 0.8."""
    rng = random.Random(3)
    word = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(word, k=rng.choice([20, 35, 50])))) for i in range(120)]
    index, seen, tried, found = DC.Index(items, 5, 15, 0.8), {}, Counter(), Counter()
    for _ in range(12):
        for i, text in items:
            own = text.split()
            changed = list(own)
            for at in rng.choice([[0], [len(own) - 1], [0, len(own) - 1], [rng.randrange(len(own))], [5, 6], [1, 2, 3]]):
                changed[at] = rng.choice(word)
            a, b = (Counter(tuple(x[j:j + 5]) for j in range(len(x) - 4)) for x in (own, changed))
            sim = DC.weighted_jaccard(a, b)
            if sim >= 0.8:
                around = [rng.choices(word, k=25) for _ in range(2)]
                hit = i in index.match(DC.word_hashes(around[0] + changed + around[1], seen))
                tried[sim >= 0.85] += 1
                found[sim >= 0.85] += hit
    assert min(tried.values()) > 150 and found[True] == tried[True] and found[False] >= 0.95 * tried[False]
