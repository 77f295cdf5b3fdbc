"""Texts in overlapping chunks: taken apart, worked on chunk by chunk, and put together in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .phrases import PLACEHOLDER

#: What ends a sentence where chunks meet, and the most sentences two chunks share there.
END, SHARED = ". ", 3


def fan_out(docs: DataFrame, size: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """key, chunk (from 0) and text: pieces of `size` sentences, each of which begins with the last `overlap` of the one before.

    The pieces of a text joined by ". ", without what they share, are the text. Null texts have no chunk, an empty one has
    one. overlap has to be less than size, and SHARED at most."""
    if not 0 <= overlap <= min(SHARED, size - 1):
        raise ValueError(f"an overlap of {overlap} sentences doesn't fit chunks of {size}")
    rows = docs.where("text is not null").select(key, F.split("text", r"\. ").alias("s"))
    # a further chunk has to hold more than it shares
    starts = F.expr(f"sequence(0, greatest(size(s) - {overlap + 1}, 0), {size - overlap})")
    return rows.select(key, "s", F.posexplode(starts).alias("chunk", "at")).select(key, "chunk", F.array_join(F.slice("s", F.col("at") + 1, size), END).alias("text"))


def boundaries(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk, s (sentences) and shared: how many sentences, SHARED at most, a chunk's beginning has in common with the end
    of the chunk before it; the most that fit, 0 for the first."""
    rows = chunks.select(key, "chunk", F.split("text", r"\. ").alias("s"))
    tail = F.expr(f"slice(s, greatest(size(s) - {SHARED - 1}, 1), {SHARED})")
    rows = rows.withColumn("tail", tail).withColumn("last", F.expr(f"lag(tail) over (partition by {key} order by chunk)"))
    fits = F.filter(F.sequence(F.lit(1), F.lit(SHARED)), lambda i: (i <= F.size("s")) & (i <= F.size("last")) & (F.slice("s", F.lit(1), i) == F.slice("last", F.size("last") - i + 1, i)))
    return rows.select(key, "chunk", "s", F.coalesce(F.array_max(F.when(F.col("last").isNotNull(), fits)), F.lit(0)).alias("shared"))


def fan_in(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text: chunks in order, without what each repeats from the end of the one before.

    A chunk that only repeats adds nothing; one that shares nothing begins a new paragraph, unless the text before ends
    with a line end. Chunks that are null or missing are left out. Only a text's own chunks meet."""
    # a null chunk, as of work that failed, doesn't stand between its neighbours
    rows = boundaries(chunks.where("text is not null"), key).withColumn("last", F.expr(f"lag(array_join(s, '{END}')) over (partition by {key} order by chunk)"))
    more = F.array_join(F.slice("s", F.col("shared") + 1, F.greatest(F.size("s"), F.lit(1))), END)
    piece = F.when(F.col("last").isNull(), F.array_join("s", END)).when((F.col("shared") > 0) & (F.col("shared") == F.size("s")), "").when(F.col("shared") > 0, F.concat(F.lit(END), more)).when(F.col("last").endswith("\n"), more).otherwise(F.concat(F.lit("\n\n"), more))
    return rows.select(key, F.struct("chunk", piece.alias("t")).alias("c")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["t"]), "").alias("text"))


def renumbered(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with the placeholders of each numbered anew, so that two chunks of a text share none.

    Each chunk numbers its own placeholders from anywhere; equal ones in a chunk stay equal, and a text's are numbered from
    0 by name in order of their first places."""
    found = chunks.select(key, "chunk", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0)))).alias("i", "old"))
    named = found.withColumn("name", F.regexp_extract("old", "^__(.+)_[0-9]+__$", 1))
    named = named.withColumn("n", F.expr(f"row_number() over (partition by {key}, name order by chunk, i) - 1"))
    new = F.concat(F.lit("__"), F.col("name"), F.lit("_"), F.col("n").cast("string"), F.lit("__"))
    maps = named.groupBy(key, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("old", new.alias("new")))).alias("m"))
    rows = chunks.join(maps, [key, "chunk"], "left")
    return rows.select(key, "chunk", F.when(F.col("m").isNull(), F.col("text")).otherwise(T.replaced(F.col("text"), PLACEHOLDER, lambda p: F.element_at(F.col("m"), p))).alias("text"))


def mapped(docs: DataFrame, work: Callable[[DataFrame], DataFrame], size: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """key and text of docs, each chunk rewritten by work (a function of rows of key, chunk and text), in order again.

    Chunks of one text are worked on in parallel; placeholders that work puts in are made different between chunks."""
    return fan_in(renumbered(work(fan_out(docs, size, overlap, key)), key), key)
