"""Chat formatting by quotation linking, in DataFrame functions only.

1. Quoted lines are parsed: a line's level is the number of ``>`` before it; a passage is a run of quoted
   lines of one level. What is left of a message (also without ``On ... wrote:`` above a quotation) is its own text.
2. Passages and their single lines, and the own texts and lines of messages, are hashed after lower-casing and
   reduction to letters and digits. The original of a hash in a conversation is the earliest message that says it.
3. A passage is linked to the original of its whole text, else to the latest of its lines' originals, if that is
   earlier than the quoting message. A message replies to the latest original of its level-one passages, or,
   where none is linked, of its deeper ones.
4. Threads come from pointer doubling over replies; rows are dealt by range to (conversation, thread's first
   turn, turn), so reading a conversation's rows in order gives every message after what it replies to.

Originals are one row per conversation and hash before the join, so no passage, however common, is paired with all
messages that hold it. No step gathers a conversation in one place.

Repeated rows count once. A null text is empty and quotes nothing; a null turn or conversation takes no part in
links and is its own thread. Messages without linked quotations have no parent (they follow the turn before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash

# What a quoted line, its marks and the line above a quotation look like.
MARKS = r"^((?:[ \t]*>)+)"
QUOTED = r"(?md)^[ \t]*>[^\n]*\n?"
ANNOUNCED = r"(?md)^On [^\n]* wrote:[ \t]*\n([ \t]*>)"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def own_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, ANNOUNCED, "$1"), QUOTED, ""))


def says(text: Column) -> Column:
    """Hashes of a text and of each of its lines, without empty ones."""
    parts = F.concat(F.array(text), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda s: s != ""), F.md5))


def passages(messages: DataFrame) -> DataFrame:
    """``conv, turn, message, run, level, line_hashes, hash`` of every quoted passage."""
    quoting = messages.where(F.col("text").rlike(r"(?md)^[ \t]*>")).select("conv", "turn", "message", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = quoting.withColumn("level", level(F.col("line"))).withColumn("body", normal(F.regexp_replace("line", MARKS, "")))
    whole = Window.partitionBy("message").orderBy("at")
    runs = lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(whole), F.lit(0))).cast("int")).withColumn("run", F.sum("new").over(whole)).where((F.col("level") > 0) & (F.col("body") != ""))
    grouped = runs.groupBy("conv", "turn", "message", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("lines"))
    return grouped.select("conv", "turn", "message", "run", "level", F.transform("lines", lambda s: F.md5(s["body"])).alias("line_hashes"), F.md5(F.array_join(F.col("lines.body"), " ")).alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """``conv, turn, message, run, level, original``: every passage with the turn that it quotes, or null."""
    found = passages(messages)
    wanted = found.select("conv").distinct()
    originals = messages.where("turn is not null").join(wanted, "conv", "left_semi").select("conv", "turn", F.explode(says(F.col("own"))).alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    keys = found.select("conv", "turn", "message", "run", "level", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("hash").alias("hash"))), F.transform("line_hashes", lambda h: F.struct(F.lit(False).alias("whole"), h.alias("hash"))))).alias("k")).select("conv", "turn", "message", "run", "level", "k.whole", "k.hash")
    met = keys.join(originals, ["conv", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    return met.groupBy("conv", "turn", "message", "run", "level").agg(F.max(F.struct(F.col("original").isNotNull().alias("linked"), "whole", "original")).alias("best")).select("conv", "turn", "message", "run", "level", "best.original")


def roots(parents: DataFrame) -> DataFrame:
    """``conv, turn, root, depth`` from ``conv, turn, parent``, by pointer doubling: rounds grow with the logarithm of the depth."""
    now = stash(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        ahead = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        new = stash(now.join(ahead, ["conv", "root"], "left").select("conv", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "replies")
        moved = new.where("moved").limit(1).count()
        unstash(now)
        now = new
        if not moved:
            return now.select("conv", "turn", "root", "depth")


def format_threads(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, parent_turn, root_turn, depth, quoted, linked, formatted`` in reply order.

    ``text`` is without quotations, ``quoted`` and ``linked`` count its passages, ``formatted`` is the message in chat markup.
    """
    plain = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    messages = plain.withColumn("own", own_text(F.col("text"))).withColumn("message", F.md5(F.to_json(F.struct("conv", "turn", "role", "text"))))
    found = stash(links(messages), "links")
    counted = found.groupBy("message").agg(F.count(F.lit(1)).alias("quoted"), F.count("original").alias("linked"))
    parents = found.where("original is not null").groupBy("conv", "turn").agg(F.max(F.struct((F.col("level") == 1).alias("direct"), "original"))["original"].alias("parent"))
    threads = roots(parents)
    replies = parents.join(threads, ["conv", "turn"])
    out = messages.join(replies, ["conv", "turn"], "left").join(counted, "message", "left")
    rows = out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.col("own").alias("text"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("quoted", F.lit(0).cast("long")).alias("quoted"),
        F.coalesce("linked", F.lit(0).cast("long")).alias("linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "own", F.lit("\n")).alias("formatted"),
    )
    order = ["conv_id", "root_turn", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


#: The same in SQL for the second engine; the table is ``conversations``.
SQL = r"""
with recursive m as (select distinct conv_id conv, turn, role, coalesce(text, '') as text from conversations),
n as (select *, trim(regexp_replace(regexp_replace(text, '(?m)^On [^\n]* wrote:[ \t]*\n([ \t]*>)', '\1', 'g'), '(?m)^[ \t]*>[^\n]*\n?', '', 'g'), ' ') own, row_number() over () message from m),
l as (select conv, turn, message, t.pos, t.line from n, unnest(string_split(text, chr(10))) with ordinality t(line, pos) where regexp_matches(text, '(?m)^[ \t]*>')),
v as (select conv, turn, message, pos, length(regexp_extract(line, '^((?:[ \t]*>)+)', 1)) - length(replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '>', '')) as level,
  trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') body from l),
r as (select *, coalesce(level <> lag(level, 1, 0) over (partition by message order by pos), true) new from v),
u as (select *, sum(new::int) over (partition by message order by pos) run from r),
p as (select conv, turn, message, run, level, list(body order by pos) bodies from u where level > 0 and body <> '' group by conv, turn, message, run, level),
o as (select conv, hash, min(turn) original from (select conv, turn, trim(regexp_replace(lower(unnest(list_concat([own], string_split(own, chr(10))))), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') hash from n where turn is not null) where hash <> '' group by conv, hash),
k as (select conv, turn, message, run, level, true whole, array_to_string(bodies, ' ') hash from p union all select conv, turn, message, run, level, false, unnest(bodies) from p),
g as (select k.message, k.conv, k.turn, run, level, whole, case when original < k.turn then original end original from k left join o on o.conv = k.conv and o.hash = k.hash),
b as (select message, conv, turn, run, level, coalesce(max(original) filter (whole), max(original)) original from g group by message, conv, turn, run, level),
a as (select conv, turn, coalesce(max(original) filter (level = 1), max(original)) parent from b where original is not null group by conv, turn),
w(conv, turn, root, depth) as (select conv, turn, parent, 1::bigint from a union all select w.conv, w.turn, a.parent, w.depth + 1 from w join a on a.conv = w.conv and a.turn = w.root),
z as (select conv, turn, arg_max(root, depth) root, max(depth) depth from w group by conv, turn),
c as (select message, count(*) quoted, count(original) linked from b group by message)
select n.conv conv_id, n.turn, role, own as text, parent parent_turn, coalesce(root, n.turn) root_turn, coalesce(depth, 0) as depth, coalesce(quoted, 0) quoted, coalesce(linked, 0) linked,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || own || chr(10) formatted
from n left join a on a.conv = n.conv and a.turn = n.turn left join z on z.conv = n.conv and z.turn = n.turn left join c on c.message = n.message
"""
