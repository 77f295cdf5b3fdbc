"""Scalar text functions, all as built-in expressions.

Character classes are ASCII, so that other engines can give the same results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as batches_

#: Where sentences end (white space after the mark, so 3.14 is whole), and the patterns of tokens and words.
SENTENCE_END = r"\n+|(?<=[.!?])[ \t\n\r\f]+"
TOKEN = r"[a-z0-9']+"
WORD = r"[A-Za-z0-9_']+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often a lambda in use reads it."""
    return F.transform(F.array(value), use)[0]


def replaced(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """text with every match m of the pattern as new(m), in one scan; the pattern matches no empty text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = let(F.transform(found, new), lambda f: F.array_join(F.zip_with(F.split(text, pattern), f, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def squeezed(text: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def signature(text: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    found = F.transform(F.split(text, SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\r\f")))
    return F.filter(found, lambda s: F.length(s) > 0)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.btrim(p, F.lit(" \t\r\f\n"))), lambda p: F.length(p) > 0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Estimated tokens: words, at least 1."""
    return F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long")


def token_bin(n: Column) -> Column:
    return F.when(n < 512, "xs").when(n < 2048, "sm").when(n < 8192, "md").when(n < 16384, "lg").otherwise("xl")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def similarity(original: Column, rewritten: Column) -> Column:
    """0.7 of word overlap, 0.15 of how much of the length and 0.15 of how many of the sentence
    marks are left, neither above 1, to three digits; 0 where either has no word."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9_]+"), F.lit(0)))
    marks = lambda t: F.greatest(F.regexp_count(t, F.lit("[.!?]")), F.lit(1))
    left = lambda a, b: F.least(b / a, F.lit(1.0))
    score = let(F.struct(words(original).alias("a"), words(rewritten).alias("b")), lambda w: F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0), F.lit(0.0)).otherwise(
        0.7 * jaccard(w["a"], w["b"]) + 0.15 * left(F.length(original), F.length(rewritten)) + 0.15 * left(marks(original), marks(rewritten))))
    return F.round(score + 1e-9, 3)


def without_articles(text: Column) -> Column:
    # nothing follows the run, so it may be possessive, which Java goes through in a loop: else each article takes stack
    return F.regexp_replace(text, r"(^|[ \t\n])(?:(?:[Tt]he|[Aa]n?)[ \t]+)++", "$1")


def tight_punctuation(text: Column) -> Column:
    """Runs of full stops as one, no space before and one space after commas, colons and semicolons."""
    text = F.regexp_replace(text, r"\.{2,}", ".")
    text = F.regexp_replace(text, "[ \t]+([,:;])", "$1")
    return F.regexp_replace(text, "([,:;])[ \t]+", "$1 ")


def tidy_space(text: Column) -> Column:
    """At most one blank line, one space between words, none at line ends."""
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.btrim(F.regexp_replace(text, "[ \t]{2,}", " "))


#: Numbers with separators of thousands, decimals with three digits or more, and negation.
THOUSANDS = r"\b[0-9]{1,3}(?:[ ,_][0-9]{3})+(?:\.[0-9]+)?\b"
DECIMALS = r"-?\b[0-9]+\.[0-9]{3,}\b(?!\.[0-9])"
NEGATION = r"(?i)\b(?:not|never|no|without|cannot|can't|don't|doesn't|won't|isn't|aren't|wasn't|weren't|shouldn't|wouldn't|couldn't)\b"


def plain_numbers(text: Column) -> Column:
    """1,234,567 becomes 1234567, with spaces or underscores alike; leading zeros go."""
    return replaced(text, THOUSANDS, lambda m: F.regexp_replace(F.regexp_replace(m, "[ ,_]", ""), "^0+([0-9])", "$1"))


def short_decimals(text: Column) -> Column:
    """Decimals of three digits or more: whole ones as integers, those below 1000 to two digits unless
    nothing would be left, larger ones as integers; ties go to the even digit."""

    def new(m: Column) -> Column:
        x = m.cast("double")
        two = F.bround(x, 2)
        plain = lambda v: F.regexp_replace(v.cast("decimal(30,2)").cast("string"), r"\.?0+$", "")
        return F.when(x == F.floor(x), F.floor(x).cast("string")).when((F.abs(x) < 1000) & (two == 0), m).when(F.abs(x) < 1000, plain(two)).otherwise(F.bround(x, 0).cast("long").cast("string"))

    return replaced(text, DECIMALS, new)


def prose_may_change(segment: Column) -> Column:
    """Whether extra replacements may be made in a segment: not empty, no question, no negation."""
    return F.coalesce((F.length(segment) > 0) & ~segment.contains("?") & ~segment.rlike(ascii_words(NEGATION)), F.lit(False))


def char_entropy(token: Column) -> Column:
    """0.35 of the share of distinct characters, 0.3 of symbols, 0.2 of digits, 0.15 of capitals, less 0.2 of
    the share of repeated ones, within 0 to 1; 0 for the empty token."""
    n = F.length(token)
    part = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    unique = F.size(F.array_distinct(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)))) / n
    score = 0.35 * unique + 0.3 * part("(?s)[^A-Za-z0-9_]") + 0.2 * part("[0-9]") + 0.15 * part("[A-Z]") - 0.2 * F.greatest(1 - unique, F.lit(0.0))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


#: What keeps a token before any model is asked.
CODE_SIGNS = r"[`{}\[\]()=;:#<>]|->"
KEPT_WORDS = r"\b(?:must|should|ensure|required|never|always|only|import|return|def|class)\b"


def sure_to_stay(token: Column, least: float = 0.62) -> Column:
    return token.rlike(CODE_SIGNS) | F.lower(token).rlike(KEPT_WORDS) | (char_entropy(token) >= least)


def tokens_after(before: Column, after: Column, tokens: Column) -> Column:
    """Tokens of a rewritten text, from the characters that one of the original's has, 1.5 at least."""
    n = F.length(before)
    each = F.when(n > 0, F.greatest(n / F.greatest(tokens, F.lit(1)), F.lit(1.5))).otherwise(4.0)
    return F.greatest(F.lit(0), tokens + F.bround((F.length(after) - n) / each).cast("long"))


def low_quality(text: Column) -> Column:
    """Whether a rewrite is empty or speaks of the task instead of doing it."""
    t = F.lower(F.btrim(text, F.lit(" \t\r\n")))
    phrases = "to make it easier|please use|step-by-step guide|use the exact wording"
    return F.coalesce((F.length(t) == 0) | t.rlike(phrases) | (F.regexp_count(t, F.lit("please")) >= 3), F.lit(True))


#: Values that a rewrite must keep: settings, instance ids and dates.
HARD_VALUES = (r"\b[A-Z][A-Z0-9_]{2,}=[^ \t\n\r\f,;|<>\"']+", r"(?i)\bi-[0-9a-f]{17}\b", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b")


def hard_values(text: Column, most: int = 64) -> Column:
    """Distinct settings, instance ids and dates of a text, kind by kind, each in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in HARD_VALUES]))
    return F.slice(F.array_distinct(found), 1, most)


def with_values(text: Column, values: Column) -> Column:
    """The text, with a sentence that names the values missing in it."""
    missing = F.filter(values, lambda v: ~F.contains(text, v))
    joint = F.when(F.rtrim(text).rlike("[.!?]$"), F.lit(" ")).otherwise(F.lit(". "))

    def named(m: Column) -> Column:
        n = F.size(m)
        listed = F.when(n == 1, m[0]).when(n == 2, F.concat(m[0], F.lit(" and "), m[1])).otherwise(F.concat(F.array_join(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.get(m, n - 1)))
        return F.when(n == 0, text).otherwise(F.btrim(F.concat(F.rtrim(text), joint, F.lit("Include "), listed, F.lit("."))))

    return let(missing, named)


#: Contractions: auxiliary verbs with a negation, by rule, and those that change their form.
CONTRACTIONS = {f"{v} not": f"{v}n't" for v in ("do", "does", "did", "is", "are", "was", "were", "has", "have", "had", "would", "should", "could")} | {"cannot": "can't", "will not": "won't", "it is": "it's"}
#: Words for which a sign stands.
SYMBOLS = {"percent": "%", "greater than": ">", "less than": "<", "and so on": "etc."}
#: Long-winded phrases of general English and what says the same; this library's own list.
PHRASES = {"in the event that": "if", "by means of": "by", "despite the fact that": "though", "in the near future": "soon", "a great deal of": "much", "for the reason that": "because", "take into consideration": "consider", "make a decision": "decide", "on two occasions": "twice", "in a timely manner": "promptly"}
#: What `shortened` replaces unless the caller has a table of its own.
SHORT = CONTRACTIONS | SYMBOLS | PHRASES


def literal(phrase: str) -> str:
    """The phrase as a pattern, for Java's and RE2's regular expressions alike."""
    return "".join("\\" + c if c in r".^$*+?()[]{}|\-" else c for c in phrase)


def ascii_words(pattern: str) -> str:
    r"""A case-insensitive pattern of \b and plain words for Java, as RE2 and so SQL reads it: only ASCII letters, digits and the
    underscore are of a word, where Java of some versions takes all letters, and the long s and the Kelvin sign are an s and a k.

    \b has to stand at the ends of words that begin and end with such characters."""
    pattern = re.sub(r"(?<!\\)[sSkK]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0].lower()], pattern)
    begins = pattern.replace(r"\b(", "(?<![A-Za-z0-9_])(")
    return begins.replace(r"\b", "(?![A-Za-z0-9_])")


def alternation(phrases) -> str:
    """Any of the phrases as whole words, longer ones first."""
    return r"\b(?:" + "|".join(literal(p) for p in sorted(phrases, key=lambda x: (-len(x), x))) + r")\b"


def shortened(text: Column, rules: Mapping[str, str] = SHORT) -> Column:
    """Phrases by the rules' short forms, longer phrases first, in one scan: the text is cut at all
    matches and joined with what they become."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return replaced(text, alternation(rules), lambda m: F.element_at(table, m))


def no_echo(text: Column) -> Column:
    """A word that follows itself goes."""
    return F.regexp_replace(text, r"\b([A-Za-z]+)(?:[ \t]+\1\b)+", "$1")


#: Words of directives, wherever they stand.
DIRECTIVES = [
    "do not", "never", "always", "must", "required", "critical", "important", "warning", "error", "failure", "success", "avoid", "prevent", "should", "need to",
    "ensure", "remember", "follow", "enforce", "constraint", "policy", "safety", "security", "limit", "without", "include", "exclude", "format", "json",
]
#: Further markers of constraints, as whole words.
CONSTRAINT_MARKERS = ["must", "must not", "never", "always", "exactly", "required", "need to", "has to", "shall", "do not", "don't", "cannot", "can't", "without"]
#: Words with which an instruction begins.
INSTRUCTION_HEADS = ["ensure", "include", "exclude", "follow", "output", "return", "format", "write", "provide", "use", "avoid", "keep", "list", "answer", "respond"]
#: Words that protect a sentence under a budget.
CONSTRAINT = r"(?i)\b(?:must|shall|required|never|do not|don't|cannot|only|exactly)\b"
_HEAD = f"^[ \\t\\n]*(?:{'|'.join(INSTRUCTION_HEADS)})(?:[^a-zA-Z'-]|$)"
CUE = f"(?i){'|'.join(DIRECTIVES)}|\\b(?:{'|'.join(CONSTRAINT_MARKERS)})\\b|{_HEAD}"
#: Of directives and markers those that hold no other one: a sentence without any of these has none.
_HINTS = [w for w in dict.fromkeys(DIRECTIVES + CONSTRAINT_MARKERS) if not any(v != w and v in w for v in DIRECTIVES + CONSTRAINT_MARKERS)]


def has_cue(sentence: Column) -> Column:
    """Whether it names a directive anywhere or a constraint, or begins as an instruction does.

    The pattern of all is tried only where the sentence holds a directive or marker, as few do."""
    hinted = let(F.lower(sentence), lambda x: functools.reduce(lambda a, b: a | b, [x.contains(w) for w in _HINTS]))
    return (hinted & sentence.rlike(CUE)) | sentence.rlike("(?i)" + _HEAD)


def has_constraint(text: Column) -> Column:
    return text.rlike(CONSTRAINT)


def n_directives(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + alternation(DIRECTIVES)))


def content_class(text: Column) -> Column:
    """The kind of a text, by the first rule that fits."""
    t = F.when(F.length(text) > 2000, F.concat(F.substring(text, 1, 666), F.substring(text, F.floor(F.length(text) / 2).cast("int") - 333, F.lit(666)), F.substring(text, F.length(text) - 665, F.lit(666)))).otherwise(text)
    trimmed = F.btrim(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return (
        F.when(F.length(trimmed) == 0, "general_prose")
        .when(trimmed.rlike(r"^[\[{]") & trimmed.rlike(r"[\]}]$") & t.contains('"'), "json")
        .when(F.length(text) < 100, "short")
        .when((count(r"[{};]|=>|->|==") >= 3) | (count(r"\b(?:def|class|import|function|return|const|public)\b") >= 2), "code")
        .when(count(r"(?:^|\n)(?:user|assistant|system|User|Assistant|System):") >= 2, "dialogue")
        .when(t.rlike(r"\b(?:GET|POST|PUT|DELETE) /|\b[Ee]ndpoint\b"), "technical_doc")
        .when(count(r"(?:^|\n)(?:#{1,6} |[-*] |```)") >= 5, "markdown")
        .when(F.length(text) > 15000, "heavy_document")
        .otherwise("general_prose")
    )


def bigram_entropies(docs: DataFrame) -> DataFrame:
    """doc_id and entropy, in bits, of the pairs of neighbouring characters of texts of two or more.

    The pairs of a slice of texts are counted by one sort; nothing is shuffled. Rows of one doc_id are texts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_.sliced(batches, lambda b: batches_.text_bytes(b, 1)):
            size = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
            code = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            # the code points of the slice are numbered, so that a text and a pair are one number
            kinds = np.cumsum(np.bincount(code) > 0, dtype=np.uint64)
            number, wide = kinds[code] - np.uint64(1), kinds[-1]
            text = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            pair = np.sort(((text[:-1] * wide + number[:-1]) * wide + number[1:])[text[:-1] == text[1:]])
            edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            count = np.diff(np.concatenate((edge, [len(pair)])))
            owner = (pair[edge] // (wide * wide)).astype(np.int64)
            share = count / (size[owner] - 1)
            entropy = np.bincount(owner, -share * np.log2(share), len(size)) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropy)], ["doc_id", "entropy"])
        batches_.release()

    return docs.where(F.length("text") > 1).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, entropy double")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles, within -1 and 1; -1 where one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))), F.lit(-1.0))
