"""Chat formatting by quotation linking: quoted passages are parsed with their nesting
level, hashed in a normal form and joined to the messages that first said them; messages
come out without quotes, in reply order.

A passage is a run of lines of one quote level up to an empty line, and each of its lines
(a client may have wrapped or shortened the quote). Its normal form is its words in lower
case. The *original* of a passage is the earliest turn of the conversation that says it
unquoted: one row per (conversation, passage), a partial aggregate, so a phrase or a
conversation with a third of all rows neither pairs up nor meets in one task. A message
replies to the earlier turn it quotes at the lowest level; of several the one with the most
quoted words, then the latest. Threads and depths come from pointer doubling over the
linked messages only, landed in each round. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import text_key
from canframes.llm.spans import let
from canframes.session import land

_MARK = r"^([ \t]*>)+"
_ATTRIBUTION = r"(?i)^on .* wrote:[ \t\r]*$"
_TRIM = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 0), "[^>]", ""))


def _parsed(text: Column) -> Column:
    """Lines as (level, body)."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  ")
    return F.transform(F.split(clean, "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARK + r"[ \t]?", "").alias("body")))


def _own_text(lines: Column) -> Column:
    """The unquoted lines, less the attribution lines before a quote."""

    def own(p: Column, i: Column) -> Column:
        after = F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        return (p["level"] == 0) & ~((after > 0) & p["body"].rlike(_ATTRIBUTION))

    return F.regexp_replace(F.array_join(F.transform(F.filter(lines, own), lambda p: p["body"]), "\n"), _TRIM, "")


def _passages(lines: Column) -> Column:
    """array<struct<level, norm>>: distinct normal forms of passages and their lines."""

    def tagged(p: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        blank = lambda x: F.trim(x["body"]) == ""
        cut = (i == 0) | F.coalesce((before["level"] != p["level"]) | blank(before), F.lit(True)) | blank(p)
        return F.concat(F.when(cut, F.concat(F.lit("\x01"), p["level"].cast("string"), F.lit("\x02"))).otherwise(F.lit("\n")), p["body"])

    runs = F.filter(F.split(F.array_join(F.transform(lines, tagged), ""), "\x01"), lambda r: r != "")

    def units(run: Column) -> Column:
        def build(x: Column) -> Column:
            return F.transform(
                F.concat(F.array(x["body"]), F.split(x["body"], "\n")),
                lambda u: F.struct(x["level"].alias("level"), F.trim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " ")).alias("norm")),
            )

        parts = F.split(run, "\x02", 2)
        return let(F.struct(parts[0].cast("int").alias("level"), parts[1].alias("body")), build)

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, units)), lambda u: u["norm"] != ""))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, key, text (own), passages (level, hash, words)."""
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_key(F.col("text")).alias("key"),
        _parsed(F.col("text")).alias("lines"),
    )
    m = m.select("conv_id", "turn", "role", "key", _own_text(F.col("lines")).alias("text"), _passages(F.col("lines")).alias("p"))
    hashed = F.transform("p", lambda u: F.struct(u["level"].alias("level"), F.md5(u["norm"].cast("binary")).alias("hash"), F.size(F.split(u["norm"], " ")).alias("words")))
    return m.select("conv_id", "turn", "role", "key", "text", hashed.alias("passages"))


def _replies(said: DataFrame) -> DataFrame:
    """(conv_id, turn, key, reply_to, n_linked) of the messages that quote an earlier turn."""
    each = said.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "key", F.explode("passages").alias("u")).select("conv_id", "turn", "key", "u.*")
    originals = each.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = each.filter("level > 0").distinct()
    links = quoted.join(originals, ["conv_id", "hash"]).filter(F.col("origin") < F.col("turn"))
    weight = links.groupBy("conv_id", "turn", "key", "level", "origin").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "words", "origin"))
    return weight.groupBy("conv_id", "turn", "key").agg(best.alias("b"), F.sum("n").alias("n_linked")).select("conv_id", "turn", "key", F.col("b.origin").alias("reply_to"), "n_linked")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of the turns with a parent; a repeated turn follows its
    latest parent."""
    at = land(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")).withColumn("depth", F.lit(1)), "quote-threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = land(at.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"),
        ), "quote-threads")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, role, reply_to (turn, null for none),
    thread (turn that started it), depth, n_quoted (quoted passages and lines), n_linked
    (those with an original), text without quotes. (conv_id, thread, depth, turn) is the
    reply order: every message after the one it answers.

    Defined cases: a null text is empty; messages with a null conv_id or turn neither link
    nor are linked to and start a thread of their own; repeated rows give repeated results;
    a quote of the own or a later turn, or of another conversation, links nothing; an empty
    table gives no rows; other columns are not looked at."""
    said = land(parse(messages), "quote-parse")
    replies = land(_replies(said), "quote-replies")
    threads = _threads(replies)
    out = said.withColumn("n_quoted", F.size(F.filter("passages", lambda u: u["level"] > 0)).cast("long")).drop("passages")
    out = out.join(replies, ["conv_id", "turn", "key"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text",
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """:func:`link_quotes` sorted in reply order; a range partitioning, so that one large
    conversation spreads over partitions."""
    return link_quotes(messages).orderBy("conv_id", "thread", "depth", "turn")


ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, md5(coalesce(text, '')) AS key,
         string_split(translate(coalesce(text, ''), chr(1) || chr(2), '  '), chr(10)) AS xs FROM conversations
), parsed AS (
  SELECT *, list_transform(xs, lambda x: {'level': len(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')), 'body': regexp_replace(x, '^([ \t]*>)+[ \t]?', '')}) AS ps FROM raw
), own AS (
  SELECT rid, conv_id, turn, role, key, ps,
    regexp_replace(array_to_string(list_transform(list_filter(ps, lambda p, i: p.level = 0 AND NOT (coalesce(ps[i + 1].level, 0) > 0 AND regexp_matches(p.body, '(?i)^on .* wrote:[ \t\r]*$'))), lambda p: p.body), chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text
  FROM parsed
), runs AS (
  SELECT rid, conv_id, turn, key, unnest(list_filter(string_split(array_to_string(list_transform(ps, lambda p, i:
      (CASE WHEN i = 1 OR coalesce(ps[i - 1].level <> p.level OR trim(ps[i - 1].body) = '', true) OR trim(p.body) = '' THEN chr(1) || p.level || chr(2) ELSE chr(10) END) || p.body), ''), chr(1)), lambda r: r <> '')) AS run
  FROM own
), bodies AS (
  SELECT rid, conv_id, turn, key, CAST(string_split(run, chr(2))[1] AS BIGINT) AS level, string_split(run, chr(2))[2] AS body FROM runs
), forms AS (
  SELECT rid, conv_id, turn, key, level, unnest(list_concat([body], string_split(body, chr(10)))) AS u FROM bodies
), units AS (
  SELECT DISTINCT rid, conv_id, turn, key, level, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM forms
), said AS (SELECT *, len(string_split(norm, ' ')) AS words FROM units WHERE norm <> ''
), originals AS (SELECT conv_id, norm, min(turn) AS origin FROM said WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), links AS (
  SELECT q.*, origin FROM (SELECT DISTINCT conv_id, turn, key, level, norm, words FROM said WHERE level > 0) q JOIN originals USING (conv_id, norm) WHERE origin < turn
), weight AS (SELECT conv_id, turn, key, level, origin, sum(words) AS words, count(*) AS n FROM links GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, key ORDER BY level, words DESC, origin DESC) AS rk, sum(n) OVER (PARTITION BY conv_id, turn, key) AS n_linked FROM weight
), replies AS (SELECT conv_id, turn, key, origin AS reply_to, n_linked FROM ranked WHERE rk = 1
), parents AS (SELECT conv_id, turn, max(reply_to) AS parent FROM replies GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, parent AS above, 1 AS depth FROM parents
  UNION ALL SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM climb c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.above
), threads AS (SELECT conv_id, turn, arg_max(above, depth) AS thread, max(depth) AS depth FROM climb GROUP BY ALL
), quoted AS (SELECT rid, count(*) AS n_quoted FROM said WHERE level > 0 GROUP BY rid
)
SELECT o.conv_id, o.turn, o.role, r.reply_to, coalesce(t.thread, o.turn) AS thread, coalesce(t.depth, 0) AS depth,
       coalesce(q.n_quoted, 0) AS n_quoted, CAST(coalesce(r.n_linked, 0) AS BIGINT) AS n_linked, o.text
FROM own o LEFT JOIN replies r ON r.conv_id = o.conv_id AND r.turn = o.turn AND r.key = o.key
LEFT JOIN threads t ON t.conv_id = o.conv_id AND t.turn = o.turn LEFT JOIN quoted q ON q.rid = o.rid
"""
