"""Segments of a text, their labels, and the weights of spans, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: labels' weights, that of any other, and the patterns that tell labels apart.
LABEL_WEIGHTS = {"instruction": 0.9, "constraint": 0.85, "example": 0.6, "background": 0.4}
OTHER_WEIGHT = 0.6
CONSTRAINT = r"(?i)\b(?:must|must not|should|should not|do not|don't|never|required)\b"
EXAMPLE = r"(?i)\b(?:example|for example|sample)\b|\be\.g\.\b|```"
INSTRUCTION = r"(?i)\b(?:please|respond|return|output|write|generate|provide|follow)\b"
BACKGROUND = r"(?i)\b(?:background|context|overview|notes?)\b"
HEADING = r"(^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9 ]{0,40}:)"
_MARK = "\u0001"


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.btrim(x, F.lit(" \t\r\n\f"))), lambda x: F.length(x) > 0)


def by_headings(text: Column) -> Column:
    """Sections that begin with capitalised words and a colon, and what stands before the first."""
    return _pieces(F.regexp_replace(text, HEADING, f"$1{_MARK}$2"), _MARK)


def blocks(text: Column) -> Column:
    """Blocks parted by blank lines; without any, by markdown headings, else by bullets, else by headings
    with a colon. A blank text has none."""
    bullets = r"\n(?=[ \t]*(?:[-*•+]|\(?[0-9]+\)?[.)])[ \t]+[^ \t\n])|\n[ \t]*(?=\n)"
    found = (
        F.when(text.rlike(r"(?m)^#{1,6}[ \t]+[^ \t\n]"), _pieces(text, r"\n(?=#{1,6}[ \t]+[^ \t\n])"))
        .when(text.rlike(r"(?m)^[ \t]*(?:[-*•+]|\(?[0-9]+\)?[.)])[ \t]+[^ \t\n]"), _pieces(F.regexp_replace(text, r"[ \t]+(?=\n)", ""), bullets))
        .otherwise(by_headings(text))
    )
    return T.let(_pieces(text, "\n\n"), lambda p: F.when(F.size(p) > 1, p).otherwise(found))


def label(block: Column) -> Column:
    """label and confidence of a block."""
    as_label = lambda name, sure: F.struct(F.lit(name).alias("label"), F.lit(sure).alias("confidence"))
    example = block.rlike(EXAMPLE)
    return (
        F.when(F.lower(block).rlike("^instructions?:"), as_label("instruction", 0.9))
        .when(block.rlike(CONSTRAINT), as_label("constraint", 0.75))
        .when(example & ~block.rlike(INSTRUCTION), as_label("example", 0.65))
        .when(block.rlike(INSTRUCTION), F.when(example, as_label("instruction", 0.55)).otherwise(as_label("instruction", 0.6)))
        .when(block.rlike(BACKGROUND), as_label("background", 0.65))
        .otherwise(as_label("background", 0.3))
    )


def label_weight(name: Column) -> Column:
    """The weight of a label, case apart; OTHER_WEIGHT for null, empty and unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(name)), F.lit(OTHER_WEIGHT))


def clipped(spans: Column, length: Column) -> Column:
    """Spans (start, end, label, weight) cut to a text's length, those that are empty or beyond it gone;
    a weight is brought into 0 to 1, and comes from the label where it is null."""
    good = F.filter(spans, lambda s: (s["end"] > s["start"]) & (s["start"] < length))
    weight = lambda s: F.coalesce(F.greatest(F.lit(0.0), F.least(s["weight"], F.lit(1.0))), label_weight(s["label"]))
    one = lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], length).alias("end"), s["label"].alias("label"), F.when(s["weight"].isNull(), label_weight(s["label"])).otherwise(weight(s)).alias("weight"))
    return F.transform(good, one)


def range_weight(start: Column, end: Column, spans: Column) -> Column:
    """The weight of the first span that overlaps the range; 1 for an empty range or where none does."""
    over = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))
    return F.when(start >= end, F.lit(1.0)).otherwise(F.coalesce(F.get(F.transform(over, lambda s: s["weight"]), F.lit(0)), F.lit(1.0)))


def piece_weights(text: Column, spans: Column, placeholder: str = r"__[A-Za-z]+_[0-9]+__") -> Column:
    """The weight of each piece of a text between placeholders, in order."""
    sizes = F.transform(F.split(text, placeholder), F.length)
    marks = F.transform(F.regexp_extract_all(text, F.lit(placeholder), F.lit(0)), F.length)
    both = F.struct(sizes.alias("s"), marks.alias("m"))
    begin = lambda b, i: F.aggregate(F.slice(b["s"], F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(b["m"], F.lit(1), i), F.lit(0), lambda a, x: a + x)
    return T.let(both, lambda b: F.transform(b["s"], lambda n, i: range_weight(begin(b, i), begin(b, i) + n, spans)))
