"""Quotation linking: conversations without quotes, in reply order.

Each message is parsed into passages of equal quote level (leading > marks). Normalised passages are hashed; quoted ones are
joined to the message of the same conversation that first said them, before the quoting one. A message replies to the latest
message that its level-one quotes stem from; without a linked quote, to the turn before it. Where a reply doesn't go to the
turn before, a branch begins, which hangs on the branch that holds the turn replied to. The reply order goes through a branch to
its end, then through the branches that hang on it, by their first turns, each with all that hangs on it: `place` counts turns in
this order.

Scale: what was said first is one row for each (conversation, hash) before anything is joined, so no join multiplies rows
however common a passage is. Running values over a conversation go through blocks of turns, so a conversation with a large share
of all rows is dealt over many tasks. Places come from ranking the list of all branches' beginnings and ends by pointer doubling:
log(branches) rounds over narrow rows, whatever the depth, and only for conversations with several branches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

TURNS = 1024

# Quote marks, and the line that mail programs put above a quote, A-Z lower-cased.
MARKS = "[ \\t]{0,3}((?:>[ \\t]?)+)"
ATTRIBUTION = "[ \\t]*(on[^a-z0-9_].{1,200}[^a-z0-9_]wrote|.{0,100}[^a-z0-9_](wrote|said)):[ \\t\\r]*"
# End of fixed values.

_marks, _attribution = re.compile(MARKS), re.compile(ATTRIBUTION)
_lower = str.maketrans(common.UPPER, common.LOWER)
_SPACE = " \t\n\x0b\x0c\r"


def normal(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased, white space (space and the characters 9 to 13) as single spaces."""
    return b" ".join(text.encode().lower().split())  # on bytes: A-Z alone, and just that white space


def passages(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """(the message's own text, passages in order): a passage is a run of lines of one quote level without blank lines. Lines
    that only attribute the quote below them are no text of the message."""
    lines = []
    for line in text.split("\n"):
        m = _marks.match(line) if ">" in line else None
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    own, out, last = [], [], None
    for k, (level, content) in enumerate(lines):
        if level == 0:
            after = next((x for x, c in lines[k + 1 : k + 3] if x or c.strip(_SPACE)), 0)
            if after and _attribution.fullmatch(content.translate(_lower)):
                last = None
                continue
            own.append(content)
        if not content.strip(_SPACE):
            last = None
        elif level == last:
            out[-1][1].append(content)
        else:
            out.append((level, [content]))
            last = level
    return "\n".join(own).strip("\n") if any(x for x, _ in lines) else text, out


def parsed(batches, text: int, names: list[str]):
    """Arrow batches with the text at a place, plus body (null where it is the text), said: hashes, and quoted: passages with level and
    hashes to look up: the whole's, then those of all lines, the longest first; under these names."""
    import xxhash

    def h(x: bytes) -> int:
        n = xxhash.xxh64_intdigest(x)
        return n - (1 << 64) if n >> 63 else n

    one = pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("choice", pa.int32()), ("hash", pa.int64())])
    for batch in batches:
        bodies, said, quoted = [], [], []
        for t in batch.column(text):
            body, found = passages(given := t.as_py() or "")
            found = [(level, [*map(normal, ls)]) for level, ls in found]
            own = [ls for level, ls in found if not level]
            texts = {b" ".join(ls) for ls in own} | {x for ls in own for x in ls} | {b" ".join(x for ls in own for x in ls)}
            bodies.append(None if body == given else body)
            said.append(sorted(h(x) for x in texts if x))
            q = []
            for k, (level, ls) in enumerate(p for p in found if p[0]):
                keys = [b" ".join(ls), *sorted(ls, key=len, reverse=True)]
                q += [{"passage": k, "level": level, "choice": c, "hash": h(x)} for c, x in enumerate(dict.fromkeys(keys)) if x]
            quoted.append(q)
        cols = [pa.array(bodies, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, pa.list_(one))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])


def blocked(rows: DataFrame, value: str, keys: list[str], at: str, how, frame: tuple) -> DataFrame:
    """rows plus `block`, TURNS of `at`, and `carry`: how(value) over the blocks of the row's keys in the frame, before or after its own. So
    a running value needs a window over a block's rows and this, and no task takes all rows of the keys."""
    rows = rows.withColumn("block", F.floor(F.col(at) / TURNS))
    sums = rows.groupBy(*keys, "block").agg(how(value).alias("m"))
    sums = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("block").alias("block_"), how("m").over(W.partitionBy(*keys).orderBy("block").rowsBetween(*frame)).alias("carry"))
    same = F.col("block") == F.col("block_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(sums, same).drop(*(f"{k}_" for k in keys), "block_")


def places(branches: DataFrame) -> DataFrame:
    """branches: a saved table of conv, branch, top (the branch it hangs on, null for none), n (its turns). Adds depth and place (of its
    first turn).

    Every branch begins and ends in a list: after a beginning comes that of the first branch that hangs on it, else its own end; after
    an end the beginning of the next branch that hangs on the same one, else that one's end. Sums to the end of the list double
    their reach in each round."""
    several = branches.groupBy("conv").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    nodes = branches.join(several.where("c > 1"), "conv").select("conv", "branch", "top", "n", "total")
    nodes = common.saved(nodes, "branches")
    first = nodes.where("top is not null").groupBy("conv", F.col("top").alias("branch")).agg(F.min("branch").alias("first"))
    keys, after = ["conv", "top"], (1, W.unboundedFollowing)
    within = F.lead("branch").over(W.partitionBy("conv", "top", "block").orderBy("branch"))
    nodes = blocked(nodes, "branch", keys, "branch", F.min, after).withColumn("next", F.coalesce(within, "carry")).join(first, ["conv", "branch"], "left")
    begins = F.struct(
        F.lit(0).alias("side"), F.coalesce("first", "branch").alias("to"), F.when(F.col("first").isNull(), 1).otherwise(0).alias("to_side"), F.col("n").alias("sum"), F.lit(1).alias("deep")
    )
    ends = F.struct(F.lit(1).alias("side"), F.coalesce("next", "top").alias("to"), F.when(F.col("next").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("deep"))
    now = common.saved(nodes.select("conv", "branch", "total", F.inline(F.array(begins, ends))), "list")
    while not now.where("to is not null").isEmpty():
        on = now.select("conv", F.col("branch").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("to2"), F.col("to_side").alias("side2"), F.col("sum").alias("sum2"), F.col("deep").alias("deep2"))
        both = now.join(on, ["conv", "to", "to_side"], "left").select(
            "conv", "branch", "total", "side", F.col("to2").alias("to"), F.col("side2").alias("to_side"),
            (F.col("sum") + F.coalesce("sum2", F.lit(0))).alias("sum"), (F.col("deep") + F.coalesce("deep2", F.lit(0))).alias("deep"),
        )
        new = common.saved(both, "list")
        common.drop_saved(now)
        now = new
    found = now.where("side = 0").select("conv", "branch", (-F.col("deep")).alias("depth"), (F.col("total") - F.col("sum")).alias("place"))
    return branches.join(found, ["conv", "branch"], "left").withColumns({"depth": F.coalesce("depth", F.lit(0)), "place": F.coalesce("place", F.lit(0)).cast("long")})


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages plus body (text without quotes), n_quotes, n_linked, reply_to (turn, null for none), branch (turn that began
    it), top (the branch it hangs on, null for none), depth (branches above it) and place (of the turn in the reply order, from 0).

    A null text has a null body and says nothing. Messages without conversation or turn link with nothing and are a branch of
    their own, without a place. Repeated rows, and rows that share a turn, come back as often as they were given and share its place.
    An empty table gives no rows. Other columns pass through; those with the names above are replaced.
    """
    new = ["body", "n_quotes", "n_linked", "reply_to", "branch", "top", "depth", "place"]
    names = [c for c in messages.columns if c not in new]
    rid, body, said, quoted = own = common.fresh(names, "_rid", "_body", "_said", "_quoted")
    with common.temporary():
        rows = messages.select(*(f"`{c}`" for c in names)).withColumn(rid, F.monotonically_increasing_id())
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
        kinds += [f"`{body}` string", f"`{said}` array<long>", f"`{quoted}` array<struct<passage: int, level: int, choice: int, hash: long>>"]
        rows = rows.mapInArrow(common.on_workers(__name__, "parsed", text=names.index(text), names=own[1:]), ", ".join(kinds))
        rows = common.kept(common.saved(rows, "messages"))  # written at once: the numbers stay
        at = rows.select(F.col(rid).alias("rid"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("t"), F.col(said).alias("said"), F.col(quoted).alias("quoted"))
        msgs = at.where("conv is not null and t is not null")
        first = msgs.select("conv", "t", F.explode("said").alias("hash")).groupBy("conv", "hash").agg(F.min("t").alias("origin"))
        quotes = msgs.select("rid", "conv", "t", F.explode("quoted").alias("q")).select("rid", "conv", "t", "q.*")
        hits = quotes.join(first, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("t"), F.col("origin")))
        per = hits.groupBy("rid", "passage", "level").agg(F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("choice"))).alias("origin"))
        per = per.groupBy("rid").agg(
            F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("by_quote")
        )
        before = msgs.select("conv", (F.col("t") + 1).alias("t"), F.col("t").alias("before")).distinct()
        replies = (
            msgs.select("rid", "conv", "t").join(per, "rid", "left").join(before, ["conv", "t"], "left")
            .withColumn("reply_to", F.coalesce("by_quote", "before")).select("rid", "conv", "t", "n_quotes", "n_linked", "reply_to")
        )
        replies = common.kept(common.saved(replies, "replies"))
        # rows that share a turn share its branch: one row a turn from here; a branch's turns follow each other without a gap
        start = F.when(F.coalesce(F.col("reply_to") != F.col("t") - 1, F.lit(True)), F.col("t"))
        starts = common.saved(replies.groupBy("conv", "t").agg(F.max("reply_to").alias("reply_to")).withColumn("start", start), "starts")
        within = F.max("start").over(W.partitionBy("conv", "block").orderBy("t"))
        turns = blocked(starts, "start", ["conv"], "t", F.max, (W.unboundedPreceding, -1)).withColumn("branch", F.coalesce(within, "carry"))
        turns = common.saved(turns.select("conv", "t", "reply_to", "branch"), "turns")
        heads = turns.groupBy("conv", "branch").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("t") == F.col("branch"), F.col("reply_to"))).alias("reply_to"))
        tops = turns.select("conv", F.col("t").alias("reply_to"), F.col("branch").alias("top"))
        heads = common.saved(heads.join(tops, ["conv", "reply_to"], "left").select("conv", "branch", "top", "n"), "heads")
        found = turns.select("conv", "t", "branch").join(places(heads).drop("n"), ["conv", "branch"]).withColumn("place", F.col("place") + F.col("t") - F.col("branch"))
        found = common.kept(common.saved(found, "places"))
    info = replies.join(found, ["conv", "t"]).select(F.col("rid").alias(rid), *new[1:])
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_quotes", "n_linked")}
    return (
        rows.drop(said, quoted).join(info, rid, "left").withColumns({"body": F.coalesce(body, text)} | zero)
        .select(*(f"`{c}`" for c in names), *new)
    )


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all conversations without their quotes, with their place in the reply order."""
    messages = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return linked(messages).drop("text")


_S = "[\\x20\\x09-\\x0D]"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{common.UPPER}', '{common.LOWER}'), '{_S}+', ' ', 'g'), ' ')"


OP8_SQL = rf"""
WITH RECURSIVE msg AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msg WHERE text IS NOT NULL),
lv AS (
  SELECT rid, i, line, regexp_extract(line, '^{MARKS}') AS mark, regexp_extract(line, '^{MARKS}', 1) AS m FROM ln),
pt AS (
  SELECT rid, i, length(m) - length(replace(m, '>', '')) AS level, substr(line, length(mark) + 1) AS content, {_normal("substr(line, length(mark) + 1)")} AS norm FROM lv),
nb AS (
  SELECT *, lead(level, 1, 0) OVER o AS l1, lead(norm, 1, '') OVER o AS n1, lead(level, 2, 0) OVER o AS l2 FROM pt WINDOW o AS (PARTITION BY rid ORDER BY i)),
kd AS (
  SELECT *, level = 0 AND (l1 > 0 OR (n1 = '' AND l2 > 0)) AND regexp_full_match(translate(content, '{common.UPPER}', '{common.LOWER}'), '{ATTRIBUTION}') AS attr FROM nb),
ru AS (SELECT *, CASE WHEN NOT attr AND norm <> '' THEN level END AS k FROM kd),
st AS (SELECT *, CASE WHEN k IS NOT NULL AND k IS DISTINCT FROM lag(k) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS s FROM ru),
ps AS (SELECT *, sum(s) OVER (PARTITION BY rid ORDER BY i) AS p FROM st),
body AS (
  SELECT rid, CASE WHEN max(level) > 0 THEN trim(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0 AND NOT attr), ''), chr(10)) END AS body FROM ps GROUP BY rid),
whole AS (SELECT rid, p, any_value(k) AS level, string_agg(norm, ' ' ORDER BY i) AS w FROM ps WHERE k IS NOT NULL GROUP BY rid, p),
said AS (
  SELECT rid, w FROM whole WHERE level = 0 UNION SELECT rid, norm FROM ps WHERE k = 0 UNION SELECT rid, string_agg(w, ' ' ORDER BY p) FROM whole WHERE level = 0 GROUP BY rid),
first AS (SELECT conv_id, w, min(turn) AS origin FROM said JOIN msg USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
look AS (
  SELECT rid, p, level, w, 0 AS c, 0 AS i FROM whole WHERE level > 0
  UNION ALL SELECT rid, p, k, norm, -strlen(norm), i FROM ps WHERE k > 0 AND NOT (norm = (SELECT w FROM whole x WHERE x.rid = ps.rid AND x.p = ps.p))),
rk AS (SELECT *, row_number() OVER (PARTITION BY rid, p ORDER BY CASE WHEN i = 0 THEN 0 ELSE 1 END, c, i) AS choice FROM look),
per AS (
  SELECT rid, p, rk.level, arg_min(origin, choice) FILTER (origin < turn) AS origin
  FROM rk JOIN msg USING (rid) LEFT JOIN first ON first.conv_id = msg.conv_id AND first.w = rk.w WHERE msg.conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
q AS (SELECT rid, count(*) AS n_quotes, count(origin) AS n_linked, max(origin) FILTER (level = 1) AS by_quote FROM per GROUP BY rid),
tn AS (SELECT DISTINCT conv_id, turn FROM msg WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
rep AS (
  SELECT rid, msg.conv_id, msg.turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(by_quote, b.turn) AS reply_to
  FROM msg LEFT JOIN q USING (rid) LEFT JOIN tn b ON b.conv_id = msg.conv_id AND b.turn = msg.turn - 1 WHERE msg.conv_id IS NOT NULL AND msg.turn IS NOT NULL),
one AS (SELECT conv_id, turn, max(reply_to) AS reply_to FROM rep GROUP BY ALL),
br AS (
  SELECT *, max(CASE WHEN coalesce(reply_to <> turn - 1, true) THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch FROM one),
hd AS (SELECT h.conv_id, h.branch, t.branch AS top FROM br h LEFT JOIN br t ON t.conv_id = h.conv_id AND t.turn = h.reply_to WHERE h.turn = h.branch),
tree AS (
  SELECT conv_id, branch, top, [branch] AS path FROM hd WHERE top IS NULL
  UNION ALL SELECT hd.conv_id, hd.branch, hd.top, list_append(tree.path, hd.branch) FROM tree JOIN hd ON hd.conv_id = tree.conv_id AND hd.top = tree.branch),
pl AS (
  SELECT br.conv_id, br.turn, br.branch, top, len(path) - 1 AS depth, row_number() OVER (PARTITION BY br.conv_id ORDER BY path, br.turn) - 1 AS place
  FROM br JOIN tree ON tree.conv_id = br.conv_id AND tree.branch = br.branch)
SELECT msg.conv_id, msg.turn, role, coalesce(body.body, text) AS body, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, branch, top, depth, place
FROM msg LEFT JOIN body USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN pl ON pl.conv_id = msg.conv_id AND pl.turn = msg.turn"""
