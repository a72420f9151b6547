"""Operator 1, chat formatting by quotation linking.

Messages (conv_id, turn, role, text) quote earlier ones with ``>`` marks, possibly nested.

1. Lines are parsed into a quote level (number of leading marks) and a body; neighbouring lines of one
   level form a passage.
2. Passages and their lines are normalised (case, white space) and hashed with the conversation.  All
   writers of a hash are kept; in the order of (hash, turn) every quotation sees the latest one of an
   earlier turn before it, so that no pairs are formed.  The order is cut into ranges, each followed on
   its own, and the last writer of a cut is handed on to the next ones.
3. A quoted passage votes for originals with the characters matched; the nearest wins a tie.  The
   original of the least quoted level is what a message replies to; a message without a linked
   quotation replies to the one before it.
4. Reply chains are resolved by pointer doubling, each round written to the shared folder, into paths
   from the first message; their order is the reply order, numbered by a range sort over all messages,
   so that no conversation needs a task of its own for it.
5. The result has every message without its quotations.

DataFrame functions only.

Defined cases: a null or empty text is an empty message; quotations of nothing known stay unlinked and
are removed too; repeated rows (equal in all four columns) count once; messages without conv_id form
one conversation; null turns come first; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.llm.common import read_table, stored
from glazier.plans.ids import assign_dense_ids

_MARKS = r"^((?:[ \t]*>)+)"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mid, run, level, body): the passages of every message in their order."""
    line = F.col("line")
    marks = F.regexp_extract(line, _MARKS, 1)
    lines = (messages.select("conv_id", "turn", "mid", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
             .select("conv_id", "turn", "mid", "at",
                     (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
                     F.when(marks == "", line).otherwise(F.ltrim(F.substring(line, F.length(marks) + 1, F.length(line))))
                     .alias("body")))
    order = Window.partitionBy("mid").orderBy("at")
    starts = F.when(F.lag("level").over(order) == F.col("level"), 0).otherwise(1)
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    return (runs.groupBy("mid", "run").agg(
        F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]).alias("lines"))
        .withColumn("body", F.concat_ws("\n", "lines")))


def _units(found: DataFrame) -> DataFrame:
    """Hashed units of passages: the whole passage and its lines, with their lengths as weights."""
    whole = normalised(F.col("body"))
    lines = F.filter(F.transform("lines", normalised), lambda x: x != F.lit(""))
    units = F.concat(F.array(F.struct(F.lit(1).alias("kind"), whole.alias("unit"))),
                     F.transform(lines, lambda x: F.struct(F.lit(0).alias("kind"), x.alias("unit"))))
    return (found.filter(whole != "").select("conv_id", "turn", "mid", "run", "level", F.explode(units).alias("u"))
            .select("conv_id", "turn", "mid", "run", "level", F.length("u.unit").alias("weight"),
                    F.xxhash64("conv_id", "u.kind", "u.unit").alias("hash")))


def _latest_writers(units: DataFrame) -> DataFrame:
    """Quoting ``units`` with o, the latest (turn, mid) of an earlier turn that wrote their hash; null if none.
    Of several writers in one turn it is the one with the least mid."""
    # Writers follow the quotations of their own turn; null turns are no one's earlier turn.
    written = (units.filter("level = 0 and turn is not null").groupBy("hash", "turn").agg(F.min("mid").alias("mid"))
               .select("hash", "turn", F.lit(1).alias("wrote"), "mid", F.lit(None).cast("int").alias("run"),
                       F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight")))
    rows = written.unionByName(units.filter("level > 0").withColumn("wrote", F.lit(0)).select(written.columns))
    line = ["hash", "turn", "wrote", "mid", "run", "weight"]
    # One stored copy of the range sort: a second evaluation may cut elsewhere.
    cuts = stored(rows.orderBy(*line).withColumn("cut", F.shiftright(F.monotonically_increasing_id(), 33)), "units")
    writer = F.when(F.col("wrote") == 1, F.struct("turn", "mid"))
    # The last writer of a hash in a cut, for the hash's later cuts: only a cut's last hash has any.
    ends = cuts.groupBy("cut").agg(F.max("hash").alias("hash"))
    last = (cuts.join(F.broadcast(ends), ["cut", "hash"]).groupBy("cut", "hash")
            .agg(F.max(writer).alias("o")))  # a row a cut
    handed = last.filter("o is not null").select(F.col("cut").alias("from"), F.col("hash").alias("of"), "o")
    starts = cuts.groupBy("cut").agg(F.min("hash").alias("of"))
    handed = (starts.join(handed, "of").filter(F.col("from") < F.col("cut"))
              .groupBy(F.col("cut"), F.col("of").alias("hash")).agg(F.max("o").alias("earlier")))
    within = Window.partitionBy("cut", "hash").orderBy(*line[1:])
    seen = cuts.withColumn("o", F.last(writer, ignorenulls=True).over(within)).filter("wrote = 0")
    return (seen.join(F.broadcast(handed), ["cut", "hash"], "left")
            .select("mid", "run", "level", "weight", F.coalesce("o", "earlier").alias("o")))


def link_quotations(found: DataFrame) -> DataFrame:
    """(mid, run, level, original, original_turn) of the quoted passages that have an original."""
    votes = (_latest_writers(_units(found)).filter("o is not null")
             .groupBy("mid", "run", "level", "o").agg(F.sum("weight").alias("votes")))
    return (votes.groupBy("mid", "run", "level")
            .agg(F.max_by("o", F.struct("votes", "o.turn", "o.mid")).alias("o"))
            .select("mid", "run", "level", F.col("o.mid").alias("original"), F.col("o.turn").alias("original_turn")))


def _paths(messages: DataFrame) -> DataFrame:
    """(mid, path): the messages from the first one of the reply chain to this one, as (turn, mid)."""
    chains = stored(messages.select("mid", F.col("parent").alias("up"), F.array(F.struct("turn", "mid")).alias("path")), "replies")
    while chains.filter("up is not null").limit(1).count():
        above = chains.select(F.col("mid").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        longer = chains.filter("up is not null").join(above, "up", "left").select(
            "mid", F.col("next").alias("up"),
            F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
        chains = stored(chains.filter("up is null").select("mid", "up", "path").union(longer), "replies")
    return chains.select("mid", "path")


def link_conversations(messages: DataFrame) -> DataFrame:
    """Messages in reply order without quotations: (conv_id, reply_order, turn, role, depth, parent_turn,
    n_quotes, n_linked, content)."""
    rows = stored(messages.select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
        .withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text")), "messages")
    found = stored(passages(rows), "passages")
    links = stored(link_quotations(found), "quotations")
    replied = links.groupBy("mid").agg(
        F.min_by(F.struct("original", "original_turn"), F.struct("level", "run")).alias("o"),
        F.count(F.lit(1)).alias("n_linked"))
    own = found.groupBy("mid").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "body")))),
                                      lambda x: x["body"])).alias("content"),
        F.count(F.when(F.col("level") > 0, 1)).alias("n_quotes"))
    line = Window.partitionBy("conv_id").orderBy("turn", "mid")
    before = rows.select("conv_id", "turn", "role", "mid", F.lag(F.struct("mid", "turn")).over(line).alias("last"))
    told = before.join(replied, "mid", "left").select(
        "conv_id", "turn", "role", "mid", F.coalesce("o.original", "last.mid").alias("parent"),
        F.coalesce("o.original_turn", "last.turn").alias("parent_turn"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))
    told = stored(told, "told")
    whole = told.join(_paths(told), "mid").join(own, "mid").select(
        "conv_id", "turn", "role", "mid", "path", (F.size("path") - 1).alias("depth"), "parent_turn", "n_quotes", "n_linked",
        F.trim(F.col("content")).alias("content"))
    numbered = stored(assign_dense_ids(whole, ["conv_id", "path"], 0, "number"), "reply-order")
    firsts = numbered.groupBy(F.col("conv_id").alias("conv")).agg(F.min("number").alias("first"))
    return numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv"))).select(
        "conv_id", (F.col("number") - F.col("first")).alias("reply_order"), "turn", "role", "depth", "parent_turn",
        "n_quotes", "n_linked", "content")


def mail_messages(conversations: DataFrame) -> DataFrame:
    """Stand-in input: the turns of ``conversations`` written as mail, each above the text of its own
    quoting the turn before (and, one level deeper, the turn before that)."""
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def quoted(text: Column, marks: str) -> Column:
        return F.when(text.isNotNull(), F.concat(F.regexp_replace(text, r"(?m)^", marks), F.lit("\n")))

    two, one = F.lag("text", 2).over(line), F.lag("text", 1).over(line)
    text = F.concat(F.coalesce(quoted(two, "> > "), F.lit("")), F.coalesce(quoted(one, "> "), F.lit("")),
                    F.coalesce(F.col("text"), F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def op1_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All conversations, written as quoting mail, back in reply order without quotations."""
    return link_conversations(mail_messages(read_table(spark, sf_dir, "conversations")))
