"""The rewriting pipeline as one projection, with its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions import text as T

#: Least similarity of a rewrite that is kept, and the latency and savings guards.
SIMILARITY, LATENCY_MS, SAVED_TOKENS = 0.82, 600, 20
#: The passes by the names that profiles and modes know them under, in order.
PASSES = {
    "normalize_whitespace": T.tidy_space,
    "shorten_synonyms": T.shortened,
    "remove_articles": T.without_articles,
    "compress_punctuation": T.tight_punctuation,
    "standardize_numbers": T.plain_numbers,
}


def rewrite(docs: DataFrame, mode: str = "maximum") -> DataFrame:
    """doc_id, kind, tokens before and after and text: every pass that the kind and the mode allow, and
    the original text where the rewrite isn't similar enough or loses a constraint.

    The guards look only at texts that changed. Null texts stay null, empty ones empty."""
    rows = docs.select("doc_id", "text", T.content_class(F.col("text")).alias("kind"))
    rows = rows.withColumn("off", profiles.disabled_passes(F.col("kind"), profiles.mode(F.lit(mode)))).withColumn("after", F.col("text"))
    for name, apply in PASSES.items():
        rows = rows.withColumn("after", F.when(F.array_contains("off", name), F.col("after")).otherwise(apply(F.col("after"))))
    kept = F.regexp_count("text", F.lit(T.CONSTRAINT)) == F.regexp_count("after", F.lit(T.CONSTRAINT))
    bad = (F.col("text") != F.col("after")) & ~(kept & (T.similarity(F.col("text"), F.col("after")) >= SIMILARITY))
    rows = rows.withColumn("after", F.when(bad, F.col("text")).otherwise(F.col("after")))
    return rows.select("doc_id", "kind", T.n_tokens(F.col("text")).alias("tokens_before"), T.n_tokens(F.col("after")).alias("tokens_after"), F.col("after").alias("text"))
