"""Quotation linking of chats, with DataFrame functions alone.

A line's quote level is the number of ``>`` at its start. Neighbouring lines of one level form a passage. A
passage is normalised (lower case, letters and digits, single blanks) and hashed, and joined to the earliest
message of its conversation whose own words hold it, as its whole text or as one of its lines. A passage of several
lines that no message holds as a whole is looked up line by line. A message quotes what it answers at the lowest
level and what that one had quoted at higher ones; so it replies to the source of the lowest level that is linked:
of several there, to the one that holds most of its characters, of equals to the latest. A message without a link
replies to the one before it. The result has each message without its quotes, the message it replies to, and an
order in which replies follow what they answer.

A conversation is never one row or one task: the message before is found within blocks of turns and across
their ends; chains of replies are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

BLOCK = 1024
#: Conversations with quotes up to which their ids are broadcast to thin the messages out beforehand.
BROADCAST_IDS = 1_000_000


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    def parse(line: Column) -> Column:
        head = F.regexp_extract(line, r"^[ \t]*((?:>[ \t]*)*)", 1)
        level = F.length(F.regexp_replace(head, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(line, r"^[ \t]*(?:>[ \t]*)+", "")).otherwise(line).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), parse)


def _passages(lines: Column) -> Column:
    """array<struct<level, text>> of runs of quoted lines of one level: places where the level changes, and what
    stands between them, each line once."""
    n = F.size(lines)
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.array(n))
    runs = F.filter(F.arrays_zip(places.alias("a"), ends.alias("b")), lambda r: F.get(lines, r["a"])["level"] > 0)
    return F.transform(runs, lambda r: F.struct(F.get(lines, r["a"])["level"].alias("level"), F.array_join(F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x["body"]), "\n").alias("text")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), n_passages, n_linked, reply_to, depth, reply_order_key.

    ``depth`` counts the messages up to the one that starts the thread (``thread``); sorting a conversation by
    (depth, turn) puts every reply after what it answers; ``reply_order_key`` is that pair as text. A null
    text counts as empty and stays null. Messages with a null conversation or turn link with nothing (reply_to
    null, depth 0). Repeated rows stay; rows of one conversation and turn share their links, which are made
    from all their texts. Other columns are not read.
    """
    m = messages.select(messages[conv_col].alias("conv_id"), messages[turn_col].cast("long").alias("turn"), messages[role_col].alias("role"), messages[text_col].cast("string").alias("raw"))
    m = m.withColumn("lines", _lines(F.col("raw")))
    m = m.withColumn("own", F.filter("lines", lambda x: x["level"] == 0)).withColumn("passages", _passages(F.col("lines")))
    m = m.withColumn("text", F.when(F.col("raw").isNull(), F.lit(None)).when(F.size("passages") == 0, F.col("raw")).otherwise(F.trim(F.array_join(F.transform("own", lambda x: x["body"]), "\n"))))
    m = written(m.select("conv_id", "turn", "role", "text", "passages"), "messages")
    known = m.where("conv_id is not null and turn is not null")

    # what is quoted, as a whole and by lines, and the earliest message that holds it
    quoted = known.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("p", "q"))
    whole = normalised(F.col("q.text"))
    parts = F.filter(F.array_distinct(F.transform(F.split("q.text", "\n"), normalised)), lambda x: (x != "") & (x != whole))
    quoted = quoted.select("conv_id", "turn", "p", "q.level", whole.alias("whole"), parts.alias("parts")).where("whole <> ''")
    quoted = quoted.select("conv_id", "turn", "p", "level", F.explode(F.concat(F.array(F.struct(F.col("whole").alias("t"), F.lit(True).alias("all"))), F.transform("parts", lambda x: F.struct(x.alias("t"), F.lit(False).alias("all"))))).alias("x"))
    quoted = written(quoted.select("conv_id", "turn", "p", "level", "x.all", F.xxhash64("x.t").alias("h"), F.length("x.t").alias("n")), "quoted")
    asked = quoted.select("conv_id").distinct()
    some = known.join(F.broadcast(asked), "conv_id", "left_semi") if asked.count() <= BROADCAST_IDS else known
    held = some.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.array_append(F.split("text", "\r?\n"), F.col("text")), normalised))).alias("t")).where("t <> ''")
    held = held.select("conv_id", F.xxhash64("t").alias("h"), F.length("t").alias("n"), "turn").groupBy("conv_id", "h", "n").agg(F.min("turn").alias("source"))
    hits = quoted.join(held, ["conv_id", "h", "n"]).where("source < turn").distinct()
    # a passage counts as a whole where it is found so, else by its lines
    found = hits.groupBy("conv_id", "turn", "p", "level").agg(F.max("all").alias("any"), F.collect_list(F.struct("all", "n", "source")).alias("s"))
    hits = written(found.select("conv_id", "turn", "p", "level", F.explode(F.filter("s", lambda x: x["all"] == F.col("any"))).alias("s")).select("conv_id", "turn", "p", "level", "s.n", "s.source"), "hits")
    best = hits.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("chars")).groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "source"))["source"].alias("quote_of"))
    linked = hits.select("conv_id", "turn", "p").distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))

    # the message before, in blocks of turns
    turns = known.select("conv_id", "turn").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    within = turns.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn")))
    ends = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    ends = ends.withColumn("block_before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))).select("conv_id", "block", "block_before")
    before = within.join(ends, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("before", "block_before").alias("before"))
    up = before.join(best, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    up = written(up.select("conv_id", "turn", F.coalesce("quote_of", "before").alias("reply_to"), F.col("quote_of").isNotNull().alias("by_quote"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")), "replies")

    # depth and thread by pointer doubling
    jump = written(up.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("top"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("reply_to").isNull().alias("done")), "jump")
    while jump.where("not done").take(1):  # what has reached its thread's start is not joined again
        above = jump.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = jump.where("not done").join(above, ["conv_id", "top"]).select("conv_id", "turn", F.col("higher").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        longer = written(jump.where("done").unionByName(moved), "jump")
        discard(jump)
        jump = longer
    placed = written(up.join(jump.select("conv_id", "turn", F.col("top").alias("thread"), "depth"), ["conv_id", "turn"]), "placed")
    out = m.select("conv_id", "turn", "role", "text", F.size("passages").cast("long").alias("n_passages")).join(placed, ["conv_id", "turn"], "left")
    depth = F.coalesce("depth", F.lit(0)).cast("long")
    return out.select("conv_id", "turn", "role", "text", "n_passages", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("by_quote", F.lit(False)).alias("by_quote"), F.coalesce("thread", "turn").alias("thread"), depth.alias("depth"), F.format_string("%010d.%010d", depth, F.coalesce("turn", F.lit(0))).alias("reply_order_key"))
