"""Protection of spans, labels, headers, JSON and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What rewriting leaves alone: marks as used below, code, links, quotes, citations and numbers.
PROTECTED = r'⟦[0-9]+⟧|```[^`]*```|`[^`\n]+`|https?://[^ \t\n"<>)]+|"[^"\n]+"|\[[0-9]+\]|[0-9]+(?:[.,:/-][0-9]+)*'
MARK = "⟦([0-9]+)⟧"
#: How a section that is kept first begins, and a label at the start of a line.
HEADER = r"^[ \t\n]*(?:#{1,6}[ \t]|[A-Z][A-Za-z ]{1,40}:|(?:system|user|assistant|tool):)"
LABEL = r"(?:^|\n)([A-Z][A-Za-z]{1,30}):"


def _joined(pieces: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def protect(docs: DataFrame) -> DataFrame:
    """docs with masked, the text with a numbered mark for each protected span, and spans, the
    distinct ones by number; equal spans share a mark. A null text gives nulls."""
    found = F.regexp_extract_all("text", F.lit(PROTECTED), F.lit(0))
    rows = docs.withColumn("spans", F.array_distinct(found))
    marks = F.transform(found, lambda s: F.concat(F.lit("⟦"), (F.array_position(F.col("spans"), s) - 1).cast("string"), F.lit("⟧")))
    return rows.withColumn("masked", _joined(F.split("text", PROTECTED), marks))


def restore(masked: Column, spans: Column) -> Column:
    """The text with every mark replaced by its span; a mark without a span becomes empty."""
    numbers = F.regexp_extract_all(masked, F.lit(MARK), F.lit(1))
    return _joined(F.split(masked, MARK), F.transform(numbers, lambda n: F.get(spans, n.cast("int"))))


def repeated_labels(docs: DataFrame, least: int = 2) -> DataFrame:
    """Labels that start so many lines of a text."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LABEL), F.lit(1))).alias("label"))
    return found.groupBy("doc_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def sections(docs: DataFrame) -> DataFrame:
    """The paragraphs of each text, and whether one begins as a header does."""
    rows = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "section"))
    return rows.withColumn("is_header", F.col("section").rlike(HEADER))


def minified(json: Column) -> Column:
    """JSON without the spaces; what isn't JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def merged_ranges(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each key's ranges, those that overlap or touch merged into one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("fresh", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("run")


def sentence_spans(text: Column) -> Column:
    """start and end (of characters, end after the last) of sentences: text up to a mark or line end, without
    the white space around it. A text of marks alone is one span, a blank one has none."""
    space = F.lit(" \t\r\f\n")
    pattern = r"[^.!?\n]+[.!?]*"
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("g"))

    def spans(b: Column) -> Column:
        # the place of each sentence: the lengths of all gaps up to it and of the sentences before it
        ends = F.aggregate(
            F.zip_with(b["m"], F.slice(b["g"], 1, F.greatest(F.size(b["m"]), F.lit(1))), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(F.coalesce(x["g"], F.lit(""))) + F.length(x["m"])).alias("at"),
                F.array_append(acc["out"], F.struct(
                    (acc["at"] + F.length(F.coalesce(x["g"], F.lit(""))) + F.length(x["m"]) - F.length(F.ltrim(x["m"], space))).alias("start"),
                    (acc["at"] + F.length(F.coalesce(x["g"], F.lit(""))) + F.length(F.rtrim(x["m"], space))).alias("end"))).alias("out")),
            lambda acc: F.filter(acc["out"], lambda s: s["end"] > s["start"]),
        )
        whole = F.length(text) - F.length(F.ltrim(text, space))
        return T.let(ends, lambda e: F.when((F.size(e) > 0) | (F.length(F.btrim(text, space)) == 0), e).otherwise(F.array(F.struct(whole.alias("start"), F.length(F.rtrim(text, space)).alias("end")))))

    return T.let(both, spans)


#: How a line begins that names a constraint, and the line above those moved.
CONSTRAINT_LINE = "^(?:do not|don't|must|never|avoid|no |ensure)"
HOISTED = "Global constraints (applies to all sections below):"


def hoisted(text: Column) -> Column:
    """Lines that name a constraint and stand twice or more, bullets and numbers apart, go and are listed once
    in a block before the first line that isn't blank; a text that has such a block stays."""
    bare = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(x, F.lit(" \t\r")), r"^[-*+][ \t]*", ""), r"^[0-9]+[.)][ \t]*", ""), F.lit(" \t\r"))
    facts = lambda p: F.transform(p, lambda x: F.struct(x.alias("x"), bare(x).alias("b"), (~x.contains("__") & F.lower(bare(x)).rlike(CONSTRAINT_LINE)).alias("c")))

    def moved(s: Column) -> Column:
        named = F.transform(F.filter(s, lambda x: x["c"]), lambda x: x["b"])
        # of the sorted names those that equal the one before stand twice
        twice = T.let(F.array_sort(named), lambda a: F.array_distinct(F.filter(a, lambda x, i: (i > 0) & (F.get(a, i - 1) == x))))

        def placed(t: Column) -> Column:
            listed = F.filter(F.array_distinct(named), lambda x: F.array_contains(t, x))
            rest = F.transform(F.filter(s, lambda x: ~F.array_contains(t, x["b"])), lambda x: x["x"])
            block = F.concat(F.array(F.lit(HOISTED)), F.transform(listed, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))

            def joined(r: Column) -> Column:
                at = F.coalesce(F.get(F.filter(F.transform(r, lambda x, i: F.when(F.length(F.btrim(x, F.lit(" \t\r"))) > 0, i)), lambda i: i.isNotNull()), F.lit(0)), F.size(r))
                return F.array_join(F.concat(F.slice(r, F.lit(1), at), block, F.slice(r, at + 1, F.size(r) + 1)), "\n")

            return F.when(F.size(t) == 0, text).otherwise(T.let(rest, joined))

        return T.let(twice, placed)

    return F.when(F.lower(text).contains(HOISTED.lower()), text).otherwise(T.let(facts(F.split(text, "\n")), moved))


#: The tags around what is left alone.
TAG = r"(?i)<(/)?protect\b([^>]*)>"


def protected_chunks(text: Column) -> Column:
    """chunks (kind `text` or `protected`, value) of a text with protect tags, in order, and error: null,
    `unclosed`, `unopened`, or `attributes` on a closing tag. Nested tags are one chunk; tags go; empty text
    between tags has no chunk, empty protected content has one."""
    kind = "array<struct<kind:string,value:string>>"
    both = F.struct(F.split(text, TAG).alias("p"), F.regexp_extract_all(text, F.lit(TAG), F.lit(0)).alias("t"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"), F.lit("").alias("held"), F.array().cast(kind).alias("out"))
    chunk = lambda name, value: F.array(F.struct(F.lit(name).alias("kind"), value.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        closing, opening = x["t"].rlike("^</"), x["t"].isNotNull() & ~x["t"].rlike("^</")
        inside = acc["depth"] > 0
        held = F.when(inside, F.concat(acc["held"], x["p"])).otherwise(F.lit(""))
        plain = F.when(~inside & (F.length(x["p"]) > 0), F.concat(acc["out"], chunk("text", x["p"]))).otherwise(acc["out"])
        ends = closing & (acc["depth"] == 1)
        error = F.when(closing & x["t"].rlike(r"(?i)^</protect[^>]*[^ \t\n>][^>]*>$") & ~x["t"].rlike(r"(?i)^</protect[ \t\n]*>$"), "attributes").when(closing & ~inside, "unopened")
        return F.struct(
            (acc["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0)).alias("depth"), F.coalesce(acc["error"], error).alias("error"),
            F.when(ends, F.lit("")).otherwise(held).alias("held"), F.when(ends, F.concat(plain, chunk("protected", held))).otherwise(plain).alias("out"))

    end = lambda acc: F.struct(acc["out"].alias("chunks"), F.coalesce(acc["error"], F.when(acc["depth"] > 0, "unclosed")).alias("error"))
    return T.let(both, lambda b: F.aggregate(F.zip_with(b["p"], b["t"], lambda p, t: F.struct(p.alias("p"), t.alias("t"))), start, step, end))
