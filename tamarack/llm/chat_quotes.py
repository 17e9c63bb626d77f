"""Conversations without quotes, in the order of their replies, by linking quotations to what they quote.

Lines that begin with marks (">", nested ones too) are quoted. Neighbouring lines of one level make a passage, up to a
blank line or one of another level. A quoted passage of any level is normalised, hashed and joined to the first message
of the conversation that says it, as a passage of its own or as a line; where no one says all of it, its lines are
joined one by one. The message with most lines of the first level is the one that is replied to; where nothing of that
level is linked, the least deep level that has a link decides. Threads follow their roots, each reply stands after what
it replies to, and the messages are written without quoted lines. Everything is a built-in DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import durable, numbered, spread_join

MARKS = r"^((?:[ \t]*>)+)"


def quote_level(line: Column) -> Column:
    """How many quotation marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    """A line without marks, in lower case, with single blanks."""
    bare = F.translate(F.regexp_replace(line, MARKS, ""), "\x01\x02", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"[ \t]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """conv, turn, level, said (its lines) and n of every passage of messages (conv, turn, lines)."""
    parsed = messages.where("conv is not null and turn is not null").select("conv", "turn", F.transform("lines", lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("said"))).alias("p"))
    # a passage begins where the level changes or after a blank line; one string of all, cut at the marks
    begins = "i = 0 or p[i - 1].level <> x.level or p[i - 1].said = ''"
    marked = F.expr(f"array_join(transform(p, (x, i) -> case when x.said = '' then '' when {begins} then concat('\x01', x.level, '\x02', x.said, '\n') else concat(x.said, '\n') end), '')")
    found = parsed.select("conv", "turn", F.explode(F.split(marked, "\x01")).alias("passage")).where("passage <> ''")
    level, body = F.substring_index("passage", "\x02", 1).cast("int"), F.expr("rtrim('\n', substring_index(passage, '\x02', -1))")
    return found.select("conv", "turn", level.alias("level"), F.split(body, "\n").alias("said")).withColumn("n", F.size("said"))


def reply_links(messages: DataFrame) -> DataFrame:
    """conv, turn, reply_to, votes of the messages of (conv, turn, lines) that quote an earlier one."""
    every = passages(messages)
    whole = F.md5(F.array_join("said", "\n").cast("binary"))
    own = every.where("level = 0")
    lines = own.where("n > 1").select("conv", "turn", F.explode("said").alias("line")).select("conv", "turn", F.md5(F.col("line").cast("binary")).alias("hash"))
    originals = durable(own.select("conv", "turn", whole.alias("hash")).union(lines).groupBy("conv", "hash").agg(F.min("turn").alias("original")))
    quoted = every.where("level > 0").groupBy("conv", "turn", "level", whole.alias("hash")).agg(F.first("said").alias("said"), F.first("n").alias("n"), F.count("*").alias("times"))
    placed = durable(quoted.join(originals, ["conv", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original"))))
    linked = placed.where("original is not null").select("conv", "turn", "level", "original", (F.col("n") * F.col("times")).alias("votes"))
    single = placed.where("original is null and n > 1").select("conv", "turn", "level", "times", F.explode("said").alias("line")).withColumn("hash", F.md5(F.col("line").cast("binary")))
    single = single.join(originals, ["conv", "hash"]).where("original < turn").select("conv", "turn", "level", "original", F.col("times").alias("votes"))
    votes = linked.union(single).groupBy("conv", "turn", "level", "original").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("shallow"), "votes", "original")).alias("best"))
    return best.select("conv", "turn", F.col("best.original").alias("reply_to"), "best.votes")


def thread_roots(links: DataFrame) -> DataFrame:
    """conv, turn, root: where the replies lead in the end. Every round doubles the way that is looked back."""
    up = durable(links.select("conv", "turn", F.col("reply_to").alias("root")))
    while True:
        above = up.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        higher = durable(up.join(above, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if higher.where("moved").isEmpty():
            return up
        up = higher.drop("moved")


def linked_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For each message: conversation, turn, role, position, reply_to, n_quoted, max_level, n_linked, formatted.

    position counts from 0 in each conversation, by (root of the thread, turn, role, text). n_quoted are quoted lines,
    n_linked those of the level that decides which the message replied to says. formatted is the message with its role and
    without quotes. A null text is empty and a null role written as none; very long messages are read whole. Messages
    without a conversation or turn link to nothing; those without a conversation are numbered together, null turns come
    first. Several messages of one turn are one for links; of equally many lines the later message is replied to.
    Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), lines.alias("lines"))
    links = durable(reply_links(rows))
    own = F.filter("lines", lambda x: ~x.rlike(r"^[ \t]*>"))
    text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.expr("trim(BOTH '\\n' FROM clean)"), F.lit("\n<|end|>\n"))
    clean = rows.withColumn("clean", F.array_join(own, "\n")).select(
        "conv", "turn", "role", (F.size("lines") - F.size(own)).alias("n_quoted"), F.coalesce(F.array_max(F.transform("lines", quote_level)), F.lit(0)).alias("max_level"), text.alias("formatted")
    )
    roots = thread_roots(links)
    threaded = clean.join(links, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn")).withColumn("digest", F.md5("formatted"))
    placed = numbered(threaded, ["conv", "root", "turn", "role", "digest"])
    key = F.when(F.col("conv").isNull(), F.lit("none")).otherwise(F.concat(F.lit("of "), F.col("conv").cast("string")))
    placed = placed.withColumn("of", key)
    heads = durable(placed.groupBy("of").agg(F.min("row").alias("head"), F.count("*").alias("messages")))
    placed = spread_join(placed, heads, ["of"], "inner", "messages", placed.count())
    return placed.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), (F.col("row") - F.col("head")).alias("position"), "reply_to", "n_quoted", "max_level", F.coalesce("votes", F.lit(0)).alias("n_linked"), "formatted"
    )
