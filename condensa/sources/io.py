"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(rows: DataFrame) -> DataFrame:
    """request, item, text, mode and error of each prompt of rows of request, prompt, prompts and mode.

    A request has a prompt or a list of prompts, not both and not neither; else error says
    so and there is no text. Prompts are trimmed; blank ones are an error. Modes are
    normalised, other names included."""
    one, many = F.col("prompt").isNotNull(), F.coalesce(F.size("prompts") > 0, F.lit(False))
    error = F.when(one & many, "both").when(~one & ~many, "neither")
    items = F.when(error.isNotNull(), F.array(F.lit(None).cast("string"))).when(one, F.array("prompt")).otherwise(F.col("prompts"))
    out = rows.select("request", profiles.mode(F.coalesce("mode", F.lit("balanced"))).alias("mode"), error.alias("error"), F.posexplode(items).alias("item", "text"))
    text = F.btrim("text", F.lit(" \t\n\r"))
    return out.select("request", "item", text.alias("text"), "mode", F.coalesce("error", F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "blank")).alias("error"))


def phrase_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """phrase, symbol from a JSON map, or from lines of phrase=symbol or phrase<tab>symbol in files of other
    names; comments (#), blank lines, keys and values are dropped, and of equal phrases the last stays."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", "map<string,string>")).alias("e"))
        rows = rows.select(F.posexplode("e").alias("pos", "e")).select("pos", F.col("e.key").alias("phrase"), F.col("e.value").alias("symbol"))
    else:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where("not startswith(ltrim(line), '#')")
        rows = lines.select("pos", F.regexp_extract("line", r"^([^=\t]*)[=\t]", 1).alias("phrase"), F.regexp_extract("line", r"^[^=\t]*[=\t](.*)$", 1).alias("symbol"))
    return canonical_map(rows, "phrase", "symbol", "pos")


def canonical_map(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Trimmed pairs, keys in lower case, without blanks; of equal keys the last value by order, then by value."""
    pairs = rows.select(F.lower(F.btrim(key)).alias(key), F.btrim(value).alias(value), F.col(order).alias("at")).where((F.length(key) > 0) & (F.length(value) > 0))
    return pairs.groupBy(key).agg(F.max_by(value, F.struct("at", value)).alias(value))


def benchmark_samples(spark: SparkSession, path: str) -> DataFrame:
    """text and expected_type of the samples in JSON files of {"samples": [...]}."""
    schema = "name string, samples array<struct<text:string,expected_type:string,metadata:map<string,string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("name", F.explode("samples").alias("s")).select("name", "s.*")


def training_records(history: DataFrame, n: int, *order: str) -> DataFrame:
    """The n last rows by order whose raw and rewritten prompts aren't blank."""
    filled = lambda c: F.length(F.btrim(c, F.lit(" \t\n\r"))) > 0
    return history.where(filled("raw_prompt") & filled("optimized_prompt")).orderBy(*[F.desc(c) for c in order]).limit(n)


def longest_common(a: list[str], b: list[str]) -> list[int]:
    """1 or 0 for each token of a: whether it is in one longest common subsequence of a and b.

    Rows of the usual table are single integers with a bit a token of b, so n and m tokens take n operations on m
    bits; the way back through the rows picks the tokens."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, token in enumerate(b):
        where[token] = where.get(token, 0) | 1 << j
    # a bit of a row that isn't set is a place at which the subsequence gets longer
    rows = [full]
    for token in a:
        row = rows[-1]
        both = row & where.get(token, 0)
        rows.append(((row + both) | (row - both)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    keep, i, j = [0] * len(a), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1 == rows[i] >> (j - 1) & 1 == 1:
            j -= 1  # the token of b adds nothing
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            keep[i] = 1
    return keep


def keep_labels(rows: DataFrame, key: str) -> DataFrame:
    """key, tokens and labels of rows of key, original and kept (arrays of tokens): 1 for each token of the original
    that a longest common subsequence with the kept ones has, else 0. Null arrays are empty. A row is labelled by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(a or [], b or []) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            labels = pa.array([longest_common(a, b) for a, b in pairs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in pairs], pa.list_(pa.string())), labels], [key, "tokens", "labels"])

    return rows.select(key, "original", "kept").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, tokens array<string>, labels array<int>")


def settings(spark: SparkSession, prefix: str, defaults: dict[str, float | int | bool | str]) -> dict[str, float | int | bool | str]:
    """The session's settings below the prefix, in the types of their defaults; a default where one is
    missing or can't be read."""
    out = dict(defaults)
    for name, default in defaults.items():
        raw = spark.conf.get(f"{prefix}.{name}", None)
        if raw is None or not raw.strip():
            continue
        try:
            out[name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw.strip())
        except ValueError:
            pass
    return out


def training_split(rows: DataFrame, key: str, held_out: float = 0.1) -> DataFrame:
    """Adds split (train or eval) by a hash of the key."""
    return rows.withColumn("split", F.when(F.pmod(F.xxhash64(key), F.lit(10_000)) < held_out * 10_000, "eval").otherwise("train"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
