"""Scoring and trimming of chat histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of roles.
ROLE = {"system": 3.0, "developer": 2.5, "user": 2.0, "tool": 1.5, "assistant": 1.0}


def turn_scores(turns: DataFrame) -> DataFrame:
    """Role weight, plus 1.5 a directive, plus 1, plus 1.5 by how late the turn is."""
    w = Window.partitionBy("conv_id")
    place = F.row_number().over(w.orderBy("turn"))
    n = F.count("*").over(w)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.lower("role")), F.lit(1.0))
    score = weight + 1.5 * F.coalesce(T.n_directives(F.col("text")), F.lit(0)) + 1 + 1.5 * place / n
    return turns.select("conv_id", "turn", "role", place.alias("place"), n.alias("n"), F.round(score, 6).alias("score"))


def kept_turns(turns: DataFrame, least: int = 4) -> DataFrame:
    """conv_id, turn, role, text, score and kept of each turn.

    A chat of more than five turns keeps its best ones, as many as its keep ratio says and `least`
    at the fewest, its system turns, the last turn, the last user turn and the first reply to
    it. Where anything of an exchange is kept, so are its last user turn and its first
    reply: an exchange is user turns and the assistant's that follow them, other roles
    apart. Other chats keep all. Ties go to the earlier turn."""
    w = Window.partitionBy("conv_id")
    by_turn, upto = w.orderBy("turn"), w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turn_scores(turns).join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]).join(keep_ratios(turns).select("conv_id", "ratio"), "conv_id")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "turn"))).withColumn("least", F.greatest(F.lit(least), F.floor(F.col("n") * F.col("ratio") + 1e-9)))
    role = F.lower("role")
    rows = rows.withColumn("user", role == "user").withColumn("reply", role == "assistant")
    # an exchange begins with a user turn that follows a reply, or with the first of either
    last = F.last(F.when(F.col("user") | F.col("reply"), F.col("reply")), True).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("begins", (F.col("user") & F.coalesce(last, F.lit(True))).cast("int"))
    rows = rows.withColumn("exchange", F.when(F.col("user") | F.col("reply"), F.sum("begins").over(upto)))
    rows = rows.withColumn("last_user", F.max(F.when(F.col("user"), F.col("place"))).over(w))
    inside = Window.partitionBy("conv_id", "exchange")
    rows = rows.withColumn("end_user", F.max(F.when(F.col("user"), F.col("place"))).over(inside)).withColumn("first_reply", F.min(F.when(F.col("reply"), F.col("place"))).over(inside))
    kept = (F.col("rank") <= F.col("least")) | (role == "system") | (F.col("place") == F.col("n")) | (F.col("place") == F.col("last_user")) | ((F.col("end_user") == F.col("last_user")) & (F.col("place") == F.col("first_reply")))
    rows = rows.withColumn("own", F.coalesce(kept, F.lit(False)))
    paired = F.col("exchange").isNotNull() & F.max("own").over(inside) & F.col("end_user").isNotNull() & F.col("first_reply").isNotNull() & ((F.col("place") == F.col("end_user")) | (F.col("place") == F.col("first_reply")))
    final = (F.col("n") <= 5) | (F.col("least") >= F.col("n")) | F.col("own") | F.coalesce(paired, F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "score", final.alias("kept"))


def notes(judged: DataFrame) -> DataFrame:
    """conv_id, turn, note: a line for each turn that wasn't kept, for rows of kept_turns.

    A note is the first clause with a directive, or else the first clause, of the turn's text
    with single spaces, cut to 160 characters; of equal notes of a chat, case apart, the
    first stays. Turns without text have none."""
    clause = "[^.!?\n]*(?:" + "|".join(T.DIRECTIVES) + ")[^.!?\n]*"
    text = F.btrim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))
    rows = judged.where(~F.col("kept")).select("conv_id", "turn", "role", text.alias("text"))
    found = F.regexp_extract("text", "(?i)" + clause, 0)
    short = F.btrim(F.when(F.length(found) > 0, found).otherwise(F.regexp_extract("text", "[^.!?\n]+", 0)))
    rows = rows.select("conv_id", "turn", "role", short.alias("short")).where(F.length("short") > 0)
    cut = F.when(F.length("short") > 160, F.concat(F.rtrim(F.substring("short", 1, 157)), F.lit("..."))).otherwise(F.col("short"))
    rows = rows.select("conv_id", "turn", F.concat(F.lit("- "), F.initcap("role"), F.lit(": "), cut).alias("note"))
    first = F.row_number().over(Window.partitionBy("conv_id", F.lower("note")).orderBy("turn"))
    return rows.withColumn("first", first).where("first = 1").drop("first")


def segments(text: Column) -> Column:
    """The segments (role, content) of a transcript, cut where a line begins with a role and a colon;
    a text without roles is one segment, an empty or blank one has none; what stands before the first
    role is left out."""
    start = r"(?m)^[ \t\n]*(?=[A-Za-z0-9_\- ]+:)"
    parts = F.filter(F.split(text, start), lambda x: F.length(F.btrim(x, F.lit(" \t\n\r"))) > 0)
    head = r"^([A-Za-z0-9_\- ]+):"
    role = lambda x: F.btrim(F.regexp_extract(x, head, 1))
    content = lambda x: F.btrim(F.regexp_replace(x, head, ""), F.lit(" \t\n\r"))
    found = T.let(parts, lambda p: F.transform(F.filter(p, lambda x: x.rlike(head)), lambda x: F.struct(role(x).alias("role"), content(x).alias("content"))))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.btrim(text, F.lit(" \t\n\r")).alias("content")))
    return F.when(F.length(F.btrim(text, F.lit(" \t\n\r"))) == 0, F.array().cast("array<struct<role:string,content:string>>")).otherwise(T.let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(plain)))


def transcript(judged: DataFrame) -> DataFrame:
    """conv_id and text: the kept turns of each chat as `role: text` lines in order, then the notes."""
    lines = judged.where("kept").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.btrim(F.coalesce("text", F.lit("")))).alias("line")))).alias("a"))
    extra = notes(judged).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "note"))).alias("b"))
    body = F.when(F.col("b").isNull(), F.col("a.line")).otherwise(F.concat(F.col("a.line"), F.array(F.lit("Summary Notes:")), F.col("b.note")))
    return lines.join(extra, "conv_id", "left").select("conv_id", F.array_join(body, "\n").alias("text"))


def keep_ratios(turns: DataFrame) -> DataFrame:
    """The share of turns that a chat keeps, by its length, mean words of a turn and system turns."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n]+")), F.lit(0))
    chats = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.floor(F.avg(words)).alias("mean"), F.max((F.lower("role") == "system").cast("int")).alias("system"))
    base = F.when(F.col("n") > 50, 0.25).when(F.col("n") > 20, 0.3).otherwise(0.4) * F.when(F.col("mean") < 50, 1.2).otherwise(1.0)
    least = F.greatest(F.when(F.col("system") == 1, 0.3).otherwise(0.0), F.when(F.col("n") > 8, 8 / F.col("n")).otherwise(0.5))
    return chats.select("conv_id", "n", F.greatest(base, least).alias("ratio"))
