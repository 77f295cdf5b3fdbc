"""What a kind of content asks for: passes it goes without, changed thresholds, and technical settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By kind, the passes it goes without.
DISABLED = {
    "code": [
        "clean_instruction_noise", "shorten_synonyms", "compress_clauses", "remove_fillers", "apply_contractions", "collapse_paradoxical_phrases", "consolidate_repeated_phrases",
        "alias_json_keys", "apply_macro_dictionary", "normalize_whitespace", "final_whitespace", "compress_punctuation", "prune_low_entropy",
    ],
    "json": [
        "shorten_synonyms", "compress_clauses", "clean_instruction_noise", "apply_contractions", "remove_fillers", "normalize_whitespace", "final_whitespace",
        "compress_punctuation", "alias_json_keys", "apply_macro_dictionary",
    ],
    "dialogue": [],
    "markdown": ["compress_clauses"],
    "technical_doc": ["shorten_synonyms", "compress_clauses"],
    "heavy_document": ["clean_instruction_noise"],
    "short": ["compress_repeated_fragments", "prune_low_entropy", "summarize_history", "compress_examples"],
    "general_prose": [],
}
#: By kind, what thresholds are multiplied by or set to.
MODIFIERS = {
    "code": {"semantic_guard": 0.985, "dedup_similarity": 0.97, "entropy_budget": 0.4, "summarize_threshold": 1.1},
    "json": {"semantic_guard": 0.99, "dedup_similarity": 0.98, "entropy_budget": 0.35, "summarize_threshold": 1.2},
    "dialogue": {"summarize_threshold": 0.65, "entropy_budget": 1.35, "dedup_similarity": 0.92},
    "markdown": {"semantic_guard": 0.93, "summarize_threshold": 0.85, "entropy_budget": 1.1},
    "technical_doc": {"semantic_guard": 0.96, "query_budget": 1.05, "summarize_threshold": 0.9, "entropy_budget": 1.05},
    "heavy_document": {"entropy_budget": 1.5, "chunk_overlap": 0.15, "summarize_threshold": 0.6, "query_budget": 1.15},
    "short": {},
    "general_prose": {"query_budget": 0.9, "summarize_threshold": 0.85, "entropy_budget": 1.15},
}
#: By kind, whether frequent phrases may be learned, whether discourse weighs, how chunks are cut, whether digits stay.
SETTINGS = {
    "code": (False, False, "fixed", True), "json": (False, False, "fixed", True), "dialogue": (True, True, "structured", False), "markdown": (True, True, "structured", False),
    "technical_doc": (True, True, "structured", True), "heavy_document": (True, True, "semantic", False), "short": (False, True, "off", False), "general_prose": (True, True, "semantic", False),
}
#: Passes that the modes go without.
MODES = {
    "conservative": ["alias_json_keys", "compress_coreferences", "compress_examples", "dedup_normalized_sentences", "summarize_history", "remove_articles", "apply_symbolic_replacements", "apply_macro_dictionary"],
    "balanced": ["alias_json_keys", "compress_examples", "summarize_history", "remove_articles", "apply_symbolic_replacements", "apply_macro_dictionary"],
    "maximum": [],
}
#: Other names of the modes.
ALIASES = {"safe": "conservative", "normal": "balanced", "max": "maximum"}


def _lookup(table: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key), other)


def _strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def mode(name: Column) -> Column:
    """The mode of a name, case and white space apart; unknown ones are `maximum`."""
    return _lookup(dict(ALIASES) | {k: k for k in MODES}, F.lower(F.btrim(name)), F.lit("maximum"))


def disabled_passes(kind: Column, of_mode: Column) -> Column:
    """Passes that the mode or the kind goes without, sorted; unknown kinds lose those of general_prose."""
    own = _lookup({k: _strings(v) for k, v in DISABLED.items()}, kind, _strings(DISABLED["general_prose"]))
    return F.array_sort(F.array_union(_lookup({k: _strings(v) for k, v in MODES.items()}, of_mode, _strings([])), own))


def modifier(kind: Column, key: str, other: float = 1.0) -> Column:
    """The kind's modifier of a threshold, or `other`."""
    return _lookup({k: v[key] for k, v in MODIFIERS.items() if key in v} or {"": other}, kind, F.lit(other))


#: Numbers that mean something: tickets, versions and ids.
NUMBERS = r"\b(?:[A-Z]{2,}-[0-9]{2,}|#[0-9]{3,})\b|\bv?[0-9]+\.[0-9]+(?:\.[0-9]+){0,2}\b|\b(?:[A-Z]{2,}[0-9]{2,}|[0-9]{2,}[A-Z]{2,})\b"


def smart_context(text: Column, kind: Column, tokens: Column) -> Column:
    """The technical settings of a text: learning of frequent phrases for longer texts that allow it,
    discourse weighting, chunking, section ranking of very long structured texts, and whether digits stay."""
    allowed, discourse, chunking, digits = (_lookup({k: v[i] for k, v in SETTINGS.items()}, kind, F.lit(SETTINGS["general_prose"][i])) for i in range(4))
    n = F.length(text)
    sample = F.when(n > 4000, F.concat(F.substring(text, 1, 2000), F.substring(text, F.floor(n / 2).cast("int") - 499, F.lit(1000)), F.substring(text, n - 1999, F.lit(2000)))).otherwise(text)
    count = F.when(tokens > 0, tokens).otherwise(F.floor(n / 4))
    return F.struct(
        (allowed & (n > 2000)).alias("learn_phrases"), discourse.alias("weigh_discourse"), chunking.alias("chunking"),
        ((count > 10000) & kind.isin("heavy_document", "technical_doc", "markdown")).alias("rank_sections"), (digits | ((kind == "general_prose") & sample.rlike(NUMBERS))).alias("keep_digits"),
    )
