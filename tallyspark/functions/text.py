"""Text expressions: descriptions, merchants, templates."""

import re
from string import Formatter

from pyspark.sql import Column, functions as F

from tallyspark.functions import fixed_values as V


def squeeze(col: Column) -> Column:
    """Collapse runs of whitespace to one space and trim both ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def any_of(words: list[str]) -> str:
    """A regex alternation of literal words."""
    return "|".join(words)


def literal(word: str) -> str:
    """A word as a regex that matches it literally."""
    return re.sub(r"([\\.*+?()\[\]{}^$|])", r"\\\1", word)


def contains_any(lowered: Column, words: list[str]) -> Column:
    """True where the text holds at least one of the words."""
    return lowered.rlike("|".join(literal(word) for word in words))


def first_matching(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE over ordered (condition, value) pairs."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value)
    return chain.otherwise(default) if cases else default


def without_references(raw: Column) -> Column:
    """Drop long digit runs and everything after a pipe."""
    return squeeze(F.regexp_replace(F.regexp_replace(raw, r"\b\d{8,}\b", ""), r"\|.*$", ""))


def clean_description(raw: Column, kept: Column | None = None) -> Column:
    """Drop long digit runs and everything after a pipe; keep at most 255 characters.

    ``kept``, if given, is a column of :func:`without_references`.
    """
    raw = F.coalesce(raw, F.lit(""))
    kept = without_references(raw) if kept is None else kept
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), raw), 1, 255)


def normalise_description(desc: Column) -> Column:
    """Apply the ordered narration rewrites, then trim."""
    for pattern, replacement in V.DESCRIPTION_REWRITES:
        desc = F.regexp_replace(desc, "(?i)" + pattern, replacement)
    return F.regexp_replace(desc, r"^\s+|\s+$", "")


def title_case(col: Column) -> Column:
    """Capitalise every run of letters (digits and punctuation start a new word)."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def extract_merchant(raw: Column) -> Column:
    """Readable counterparty name: no narration prefix, no trailing reference."""
    name = F.regexp_replace(raw, V.MERCHANT_PREFIX, "")
    name = squeeze(F.regexp_replace(name, V.MERCHANT_REFERENCE, ""))
    return F.substring(F.coalesce(F.nullif(title_case(name), F.lit("")), raw), 1, 100)


def merchant_key(desc: Column) -> Column:
    """Grouping key of a description: lower-case letters without payment jargon."""
    bare = F.regexp_replace(F.lower(desc), V.MERCHANT_KEY_NOISE, "")
    return F.substring(squeeze(F.regexp_replace(bare, r"[^a-z\s]", "")), 1,
                       V.MERCHANT_KEY_CHARS)


def noise_pattern() -> str:
    return "(?i)" + any_of(V.NOISE_PATTERNS)


def is_noise(desc: Column) -> Column:
    return desc.rlike(noise_pattern())


def fill(template: str, **values: Column) -> Column:
    """A message template with its {names} replaced by columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def trigrams(col: Column) -> Column:
    """Distinct three-letter pieces of each word, padded as two blanks + word + blank."""
    words = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def pieces(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2),
                           lambda i: F.substring(padded, i, 3))

    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of both texts."""
    return F.try_divide(F.size(F.array_intersect(left, right)).cast("double"),
                        F.size(F.array_union(left, right)))
