"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: SHA-256 over its fields, each with its length. The leaves of a group
(``source``) in order of ``doc_id`` make a tree of ``fan`` children a node, up to the
group's subroot; the subroots in order of the group make one tree more, up to the root.

Nodes are labelled (group, level, index), and a node is worked on at the time of its label:
a priority queue ordered by label holds the digests that children send to their parents.
The queue is external. A round spans two levels: the messages of a round are rows, dealt
out by runs of ``fan**2`` nodes and sorted by label (Spark's sort spills), and a task holds
in its own heap only the messages of one run, so a group of any size is spread over as many
tasks as it has runs. What a run's last node sends is the next round's input. There are
about log(leaves) / log(fan**2) rounds, each ``fan**2`` times smaller than the one before.

The reversed sweep takes the written nodes in descending order of label: a node gets its
proof suffix (the siblings from its own level to the root) from the queue and sends each
child that suffix with the child's siblings before it. Suffixes go to runs of leaves, not to
single leaves; a leaf's own level is cut out of its run's digests at the end, by position.

A proof is an array of (left, right), one a level from the leaf to the root: the digests of
the siblings before and after the node, concatenated. ``fold`` recomputes a root from any
leaf digest and a proof; ``proof_digest`` names a proof.

Results: null fields count as ``-``, and a null group is a group that sorts first; a null
``doc_id`` sorts first; rows with one ``doc_id`` are ordered by their digest, and equal rows
are leaves of their own; an empty text is a field of length 0; a text of any length is
hashed by its own task and never moved; a lone leaf is its group's subroot and a lone
subroot the root; an empty table gives an empty result; columns that are not fields are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import crc32_sql, drop, save
from modelwatch.operators.prefix import row_position

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Hex digits of a digest.
WIDE = 64
PATH = "array<struct<left:string,right:string>>"
#: Rows handled at a time (each holds up to ``fan`` digests, downwards a whole suffix, too).
ROWS = 1024


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) over the fields: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each run (grp, chunk); they come sorted, a run at a time is held."""
    here, rows = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            for row in batch.slice(lo, ROWS).to_pylist():
                key = (row["grp"], row["chunk"])
                if key != here and rows:
                    yield here, rows
                    rows = []
                here = key
                rows.append(row)
    if rows:
        yield here, rows


def _up(fan: int):
    """Forward in time: the nodes of the next two levels, in order of their labels."""
    schema = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("level", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()),
                        ("kids", pa.string()), ("digest", pa.string()), ("last", pa.bool_())])

    def nodes(batches):
        for (grp, chunk), rows in _runs(batches):
            size = [rows[0]["n"]]
            for _ in range(2):
                size.append(-(-size[-1] // fan))
            queue: list[tuple] = []
            for r in rows:
                heappush(queue, (1, r["idx"] // fan, r["idx"], r["digest"]))
            while queue:
                level, idx = queue[0][:2]
                kids = []
                while queue and queue[0][:2] == (level, idx):
                    kids.append(heappop(queue)[3])
                kids = "".join(kids)
                digest = hashlib.sha256(kids.encode()).hexdigest()
                last = level == 2 or size[level] == 1
                yield grp, chunk, level, idx, size[level], kids, digest, last
                if not last:
                    heappush(queue, (level + 1, idx // fan, idx, digest))

    return lambda batches: _batches(nodes(batches), schema)


def _down(fan: int):
    """Backward in time: the suffix of every node of the lower level of a round."""
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("grp", pa.string()), ("run", pa.int64()), ("kids", pa.string()), ("top", pa.string()), ("path", pa.list_(pair))])

    def runs(batches):
        for (grp, _), rows in _runs(batches):
            first, *nodes = rows                          # the suffix that arrives, then nodes by descending label
            queue = [(-nodes[0]["level"], -nodes[0]["idx"], first["path"])]
            for node in nodes:
                level, idx, path = heappop(queue)
                if (-level, -idx) != (node["level"], node["idx"]):
                    raise ValueError(f"no suffix for node {node['level']}, {node['idx']} of {grp}")
                kids = node["kids"]
                if node["level"] == 1:
                    yield grp, node["idx"], kids, first["top"], path
                    continue
                for k in range(len(kids) // WIDE):
                    own = {"left": kids[:k * WIDE], "right": kids[(k + 1) * WIDE:]}
                    heappush(queue, (level + 1, -(node["idx"] * fan + k), [own, *path]))

    return lambda batches: _batches(runs(batches), schema)


def climb(front: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes above ``front`` (grp, idx, n, digest), a written table a round, and the top
    of every group (grp, digest, round it was reached in; 0: a lone node)."""
    rounds, tops = [], None
    while True:
        ended = front.where("n = 1").select("grp", "digest", F.lit(len(rounds)).alias("round"))
        tops = ended if tops is None else tops.unionByName(ended)
        going = front.where("n > 1").select("grp", F.expr(f"idx div {fan * fan}").alias("chunk"), "idx", "n", "digest")
        if going.isEmpty():
            return rounds, tops
        queue = going.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "idx")
        rounds.append(save(queue.mapInArrow(_up(fan), "grp string, chunk long, level long, idx long, n long, kids string, digest string, last boolean"), "nodes"))
        front = rounds[-1].where("last").select("grp", "idx", "n", "digest")


def children(runs: DataFrame, fan: int) -> DataFrame:
    """(grp, idx, top, path) of the nodes of each run."""
    each = runs.select("*", F.explode(F.sequence(F.lit(0), (F.length("kids") / WIDE).cast("int") - 1)).alias("k"))
    return each.select("grp", (F.col("run") * fan + F.col("k")).alias("idx"), "top", extended(F.col("kids"), F.col("k"), F.col("path")).alias("path"))


def extended(kids: Column, k: Column, path: Column) -> Column:
    """The path of child ``k`` of a run."""
    own = F.struct(F.substr(kids, F.lit(1), k * WIDE).alias("left"), F.substr(kids, (k + 1) * WIDE + 1).alias("right"))
    return F.concat(F.array(own), path)


def descend(rounds: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame | None:
    """(grp, run, kids, top, path) of every run of the lowest level: the suffixes of its
    parent. ``tops``: (grp, digest, round, path). None if no group has two nodes."""
    runs = None
    for at in range(len(rounds) - 1, -1, -1):
        arriving = tops.where(F.col("round") == at + 1).select("grp", F.lit(0).cast("long").alias("chunk"), F.col("digest").alias("top"), "path")
        if runs is not None:
            arriving = arriving.unionByName(children(runs, fan).withColumnRenamed("idx", "chunk"))
        both = arriving.withColumn("level", F.lit(99).cast("long")).unionByName(
            rounds[at].select("grp", "chunk", "level", "idx", "kids"), allowMissingColumns=True)
        queue = both.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", F.desc("level"), F.desc("idx"))
        done, runs = runs, save(queue.mapInArrow(_down(fan), f"grp string, run long, kids string, top string, path {PATH}"), "suffixes")
        for old in [rounds[at], *([] if done is None else [done])]:
            drop(old)
    return runs


def merkle_manifest(docs: DataFrame, fields: tuple = FIELDS, group: str = "source", order: str = "doc_id",
                    keep: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``group``, leaf, subroot, root and proof, and the
    columns of ``keep``, worked out where the leaf is hashed."""
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))      # null sorts first and joins
    carried = F.struct(F.lit(0).alias("_"), F.col(order).alias("order"), F.col(group).alias("group"),
                       *[c.alias(f"k_{name}") for name, c in (keep or {}).items()]).alias("carried")
    leaves = save(docs.select(grp.alias("grp"), F.col(order).alias("at"), leaf_digest(*map(F.col, fields)).alias("digest"), carried), "leaves")
    placed = save(row_position(leaves, ["at", "digest"], by=["grp"]).select(
        "grp", F.col("position").alias("idx"), F.col("n_rows").alias("n"), "digest", "carried"), "placed")
    drop(leaves)

    rounds, tops = climb(placed.select("grp", "idx", "n", "digest"), fan)
    tops = save(tops, "subroots")
    above = save(row_position(tops, ["grp"]).select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("position").alias("idx"),
                                                    F.col("n_rows").alias("n"), "digest", "round"), "above")
    top_rounds, top = climb(above.select("grp", "idx", "n", "digest"), fan)
    root = next((r["digest"] for r in top.take(1)), None)
    empty = F.from_json(F.lit("[]"), PATH)
    top_runs = descend(top_rounds, save(top.withColumn("path", empty), "root"), fan)
    if top_runs is None:
        tops = tops.withColumn("path", empty)
    else:
        tops = above.select("own", "idx", "digest", "round").join(children(top_runs, fan).select("idx", "path"), "idx").select(
            F.col("own").alias("grp"), "digest", "round", "path")
    tops = save(tops, "tops")

    runs = descend(rounds, tops, fan)
    lone = tops.where("round = 0").select("grp", F.lit(0).cast("long").alias("run"), F.lit("").alias("kids"), F.col("digest").alias("top"), "path")
    runs = lone if runs is None else runs.unionByName(lone)
    at = F.expr(f"idx div {fan}").alias("run")
    own = placed.select("*", at).join(runs, ["grp", "run"])
    proof = F.when(F.col("n") == 1, F.col("path")).otherwise(extended(F.col("kids"), F.pmod("idx", F.lit(fan)).cast("int"), F.col("path")))
    return own.select(F.col("carried.order").alias(order), F.col("carried.group").alias(group), F.col("digest").alias("leaf"),
                      F.col("top").alias("subroot"), F.lit(root).alias("root"), proof.alias("proof"),
                      *[F.col(f"carried.k_{name}").alias(name) for name in keep or {}])


def merkle_sql(fan: int = FAN) -> str:
    """What the registered query returns for the table ``documents``, as DuckDB SQL."""
    def leaf(text):
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def siblings(t, grp):
        same = f"a.{grp} IS NOT DISTINCT FROM b.{grp} AND " if grp else ""
        return (f"SELECT {'a.' + grp + ',' if grp else ''} a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, "
                f"coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r "
                f"FROM {t} a JOIN {t} b ON {same}a.lvl = b.lvl AND a.pos // {fan} = b.pos // {fan} WHERE a.n > 1 GROUP BY ALL")

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claim FROM documents),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
    WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
up AS (SELECT source, 0 AS lvl, pos, n, leaf AS d FROM placed UNION ALL
    SELECT source, lvl + 1, pos // {fan}, any_value((n + {fan - 1}) // {fan}), sha256(string_agg(d, '' ORDER BY pos))
    FROM up WHERE n > 1 GROUP BY source, lvl, pos // {fan}),
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE up.n = 1),
above AS (SELECT 0 AS lvl, place AS pos, n, subroot AS d FROM subroots UNION ALL
    SELECT lvl + 1, pos // {fan}, any_value((n + {fan - 1}) // {fan}), sha256(string_agg(d, '' ORDER BY pos))
    FROM above WHERE n > 1 GROUP BY lvl, pos // {fan}),
near AS ({siblings('up', 'source')}), far AS ({siblings('above', '')}),
walk AS (SELECT doc_id, source, leaf, 0 AS lvl, pos, claim AS cur, '' AS proof FROM placed UNION ALL
    SELECT doc_id, w.source, leaf, w.lvl + 1, w.pos // {fan}, sha256(l || cur || r), proof || l || r
    FROM walk w JOIN near s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos = s.pos),
arrived AS (SELECT w.*, subroot, place FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source
    ANTI JOIN near x ON w.source IS NOT DISTINCT FROM x.source AND w.lvl = x.lvl AND w.pos = x.pos),
last AS (SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, cur, proof FROM arrived UNION ALL
    SELECT doc_id, leaf, subroot, w.lvl + 1, w.pos // {fan}, sha256(l || cur || r), proof || l || r
    FROM last w JOIN far s ON w.lvl = s.lvl AND w.pos = s.pos),
top AS (SELECT d AS root, lvl AS height FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM last JOIN top ON last.lvl = top.height"""
