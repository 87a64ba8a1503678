"""Line deduplication with a fixed-depth log-template tree, in DataFrame operations only.

A line is read as tokens between ASCII white space; a token with a digit becomes the
variable field ``<*>`` if the line has a token without one, too. A line of nothing but fields
(a number, a date, a table row) has no constant token to name a template; it is compared by
its own tokens and joins no leaf. The tree has a fixed depth: its first level is the token count,
the next ``depth`` levels are the leading tokens, and what remains is a leaf. A leaf with
several different lines holds as many templates as its lines ask for, found in rounds
(``leaf_templates``). A round's template keeps at each position the token that most of the
group's lines hold (the larger token, bytewise, of those that tie); a line belongs to it if at
least ``similarity`` of its tokens agree with it, one of them not a field, and the other
positions are variable fields. The other lines stay open for the next round, as a group of
their own. If no line fits, the vote mixes several templates: the group is parted by its
tokens at the position where most lines share a token with others (the first such position);
lines whose token there is theirs alone stay together. A line without company, or in a group
of which all lines come from one document, is a template of its own: nothing found in such a
group could recur. The rounds are about as many as the templates of the fullest leaf.
Templates found in at least ``min_docs`` (2 or more) documents recur: their lines stay in the
document with the smallest doc_id and are dropped from all others.

For all lines only hashes, ids and line numbers are grouped and joined. A different line of a
shared leaf is one row throughout; its tokens are laid out only for the vote, which is
combined before its shuffle, and the vote returns as one array a group. So a line found in a
third of all documents is one row per task.

The unit is the whole line between line breaks: a passage that begins or ends inside a line is
found only on the lines that it fills.

Results: a null text stays null (0 lines); an empty text has one empty line; empty lines
always stay; a row without doc_id is passed through unchanged and not counted; repeated
rows are one document and change alike; a text of any length is read as a whole; an empty
table stays empty; other columns pass through, whatever their names (``n_lines`` and
``n_dropped`` are replaced if they exist).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import drop, save

FIELD = "<*>"
#: A token that is no field.
CONSTANT = r"(?:^| )(?!<\*>(?: |$))[^ 0-9]+(?: |$)"
#: Hash slots of the first look at shared leaves (a broadcast of that many numbers at most).
SLOTS = 1 << 20


def masked_line(line: Column) -> Column:
    """Tokens joined by single spaces, those with digits as variable fields beside a constant one."""
    odd = line.contains("  ")
    for c in "\t\r\v\f":
        odd = odd | line.contains(c)
    norm = F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D\x20]+", " ")).otherwise(line))
    return F.when(norm.rlike("[0-9]") & norm.rlike(CONSTANT), F.regexp_replace(norm, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(norm)


def leaf_templates(lines: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(h, id): the template of every line that fits one of its leaf; and the tables read for it.

    ``lines`` holds (h, grp, masked, low, high) for one copy of each different line, with the
    smallest and largest id of its documents. Ends when no group is open; no count of rounds
    cuts it short."""
    rounds = []
    while True:
        tokens = F.split("masked", " ")
        n = (lines.select("grp", F.posexplode(tokens).alias("pos", "tok"))
             .groupBy("grp", "pos", "tok").agg(F.count(F.lit(1)).alias("n")))
        at = n.groupBy("grp", "pos").agg(F.max(F.struct("n", "tok")).alias("top"), F.sum("n").alias("size"),
                                         F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))
        parting = F.when(F.col("top.n") < F.col("size"), F.col("shared")).otherwise(0)
        vote = at.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("top.tok").alias("tok")))).alias("vote"),
                                     F.max(F.struct(parting.alias("shared"), (-F.col("pos")).alias("at"))).alias("by"))
        agree = F.zip_with(tokens, F.col("vote"), lambda a, b: F.when(a == b["tok"], F.when(a == FIELD, 1).otherwise(2)).otherwise(0))
        judged = lines.join(vote, "grp").select("h", "grp", "low", "high", "masked", "by", F.size("vote").alias("n_tok"), agree.alias("agree"))
        fits = (F.size(F.filter("agree", lambda x: x > 0)) >= F.lit(similarity) * F.col("n_tok")) & F.array_contains("agree", 2)
        judged = save(judged.select("h", "grp", "low", "high", fits.alias("fits"), F.when(~fits, F.col("masked")).alias("masked"),
                                    F.col("by.shared").alias("shared"), (-F.col("by.at")).alias("at")), "judged")
        rounds.append(judged)
        # The same lines less those that fit are a new group, so that each group has one template.
        still = judged.where("not fits")
        groups = judged.groupBy("grp").agg(
            F.max("fits").alias("some"), F.count_if(~F.col("fits")).alias("n"), F.min(F.when(~F.col("fits"), F.col("low"))).alias("from"),
            F.max(F.when(~F.col("fits"), F.col("high"))).alias("to")).where("n > 1 and `from` <> `to`").select("grp", "some")
        still = still.join(groups, "grp").withColumn("tok", F.when(~F.col("some"), F.get(F.split("masked", " "), F.col("at"))))
        parted = still.where("not some and shared > 0")
        parts = parted.groupBy("grp", "tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "tok", F.col("tok").alias("part"))
        nxt = still.where("some").select("h", F.xxhash64("grp").alias("grp"), "masked", "low", "high").unionByName(
            parted.join(parts, ["grp", "tok"], "left").select("h", F.xxhash64("grp", "at", "part").alias("grp"), "masked", "low", "high"))
        done, lines = lines, save(nxt, "open")
        drop(done)
        if lines.isEmpty():
            drop(lines)
            break
    found = judged.sparkSession.read.schema(judged.schema).parquet(*[r._llm_path for r in rounds])
    return found.where("fits").select("h", F.col("grp").alias("id")), rounds


def strip_templates(docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_docs: int = 2) -> DataFrame:
    """``docs`` without the lines of recurring templates, plus n_lines and n_dropped."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    passed = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("th"))
    lines = (base.where("doc_id is not null").select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .where(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("masked", masked_line(F.col("line"))).drop("line"))
    n_tok = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n_tok", n_tok).withColumn("h", F.xxhash64("masked")).withColumn(
        "leaf", F.when((F.col("n_tok") > depth) & ~F.col("masked").rlike("[0-9]"), F.xxhash64("n_tok", F.substring_index("masked", " ", depth))))

    lines = save(lines, "lines")
    rows = lines.select("doc_id", "th", "line_no", "h", "leaf")
    kinds = rows.where("leaf is not null").groupBy("leaf", "h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = save(kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("from"), F.max("high").alias("to"))
                  .where("n > 1 and `from` <> `to`").select("leaf"), "leaves")
    # A first look by hash slot, SLOTS rows at the most whatever the corpus, so that few
    # lines of other leaves carry their text through the exact join.
    slot = F.pmod("leaf", F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(shared.select(slot).distinct())

    # Leaf templates: votes and fits count different lines, not their copies.
    different = (lines.where("leaf is not null").select("h", "leaf", "doc_id", "masked", slot)
                 .join(slots, "slot", "left_semi").drop("slot").join(shared, "leaf", "left_semi")
                 .groupBy("h", F.col("leaf").alias("grp")).agg(F.first("masked").alias("masked"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    fits, read = leaf_templates(save(different, "open"), similarity)

    # A line's template: one of its leaf where it fits one, else itself.
    named = rows.join(fits, "h", "left").select("doc_id", "th", "line_no", F.when(
        F.col("id").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("id"))).otherwise(
        F.struct(F.lit(0).alias("k"), F.col("h").alias("id"))).alias("template"))
    named = save(named, "templates")
    for old in (*read, shared, lines):
        drop(old)
    # Written, so that the join below has no aggregate in its stage and AQE can split a hot template.
    recurring = save(named.groupBy("template").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("n_docs"))
                     .where(F.col("n_docs") >= min_docs).select("template", "first"), "recurring")
    gone = (named.join(recurring, "template").where(F.col("doc_id") != F.col("first"))
            .groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone")))

    joined = base.join(gone, ["doc_id", "th"], "left")
    all_lines = F.split("text", "\n")
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in passed],
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
                         F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def strip_templates_sql(depth: int = 3, similarity: float = 0.8, min_docs: int = 2) -> str:
    """The same result for the table ``documents`` as DuckDB SQL, in the same rounds."""
    constant = f"list_has_any(list_transform(toks, lambda x: NOT regexp_matches(x, '[0-9]') AND x <> '{FIELD}'), [true])"

    def judged(rows):
        """Each line of a group with the group's vote, whether it fits, and the position that parts the group."""
        return rf"""
SELECT c.*, v.by, len(list_filter(list_zip(c.toks, v.vote), lambda x: x[1] = x[2])) >= CAST({similarity} AS DOUBLE) * len(c.toks)
       AND len(list_filter(list_zip(c.toks, v.vote), lambda x: x[1] = x[2] AND x[1] <> '{FIELD}')) > 0 AS fits
FROM {rows} c JOIN (
  SELECT grp, list(top.tok ORDER BY pos) AS vote, max({{'s': CASE WHEN top.n < size THEN shared ELSE 0 END, 'p': -pos}}) AS by FROM (
    SELECT grp, pos, max({{'n': n, 'tok': tok}}) AS top, sum(n) AS size, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS shared FROM (
      SELECT grp, pos, tok, count(*) AS n FROM (SELECT grp, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {rows}) t
      GROUP BY grp, pos, tok) n GROUP BY grp, pos) a GROUP BY grp) v ON c.grp = v.grp"""

    return rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
read AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(line, '[	-
 ]+', ' ', 'g')), ' ') AS toks
         FROM raw WHERE regexp_matches(line, '[^	-
 ]')),
masked AS (SELECT doc_id, line_no, CASE WHEN {constant}
           THEN list_transform(toks, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) ELSE toks END AS toks FROM read),
lines AS (SELECT doc_id, line_no, toks, array_to_string(toks, ' ') AS line, CASE WHEN len(toks) > {depth}
          AND NOT regexp_matches(array_to_string(toks, ' '), '[0-9]') THEN len(toks) || ' ' || array_to_string(toks[1:{depth}], ' ') END AS leaf FROM masked),
kinds AS (SELECT line, any_value(toks) AS toks, any_value(leaf) AS grp, min(doc_id) AS low, max(doc_id) AS high
          FROM lines WHERE leaf IS NOT NULL GROUP BY line),
start AS (SELECT * FROM kinds WHERE grp IN (SELECT grp FROM kinds GROUP BY grp HAVING count(*) > 1 AND min(low) <> max(high))),
open AS (SELECT line, toks, grp, low, high FROM start
  UNION ALL
  SELECT line, toks, grp, low, high FROM (
    WITH cur AS (SELECT * FROM open), judged AS ({judged('cur')}),
    groups AS (SELECT grp, bool_or(fits) AS few FROM judged GROUP BY grp HAVING count(*) FILTER (WHERE NOT fits) > 1
               AND min(low) FILTER (WHERE NOT fits) <> max(high) FILTER (WHERE NOT fits)),
    still AS (SELECT j.*, few, j.toks[-j.by.p] AS tok FROM judged j JOIN groups USING (grp) WHERE NOT fits),
    parts AS (SELECT grp, tok FROM still WHERE NOT few GROUP BY grp, tok HAVING count(*) > 1)
    SELECT s.line, s.toks, CASE WHEN few THEN s.grp || '+' WHEN p.tok IS NULL THEN s.grp || '|' || s.by.p || '|'
                                ELSE s.grp || '|' || s.by.p || '|=' || p.tok END AS grp, s.low, s.high
    FROM still s LEFT JOIN parts p ON s.grp = p.grp AND s.tok = p.tok WHERE few OR s.by.s > 0) step),
fits AS (SELECT line, grp FROM ({judged('open')}) j WHERE fits),
named AS (SELECT doc_id, line_no, CASE WHEN f.grp IS NULL THEN 'line ' || l.line ELSE 'leaf ' || f.grp END AS template
          FROM lines l LEFT JOIN fits f ON l.line = f.line AND l.leaf IS NOT NULL),
recurring AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= {min_docs}),
gone AS (SELECT DISTINCT doc_id, line_no FROM named JOIN recurring USING (template) WHERE doc_id <> first)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
       coalesce(g.n_dropped, 0) AS n_dropped, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
           FROM raw ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id) k USING (doc_id)"""
