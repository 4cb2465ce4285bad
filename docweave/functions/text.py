"""Text expressions: tokens, titles, links, sentences, bigrams, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4E00}-\x{9FFF}]"
WORD_NOT_CJK = r"[\p{L}\p{N}_&&[^\x{4E00}-\x{9FFF}]]+"


def rows_of(array: Column) -> Column:
    """Generator over an array that is costly to make, such as the words of a text.

    A plain explode lets the optimizer add ``size(array) > 0`` below it, which makes the
    array a second time and before any repartitioning. The outer form does not; callers
    drop the null row of an empty array.
    """
    return F.explode_outer(array)


def bigrams(text: Column) -> Column:
    """Overlapping two-character windows of a string, in order (empty when too short)."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))"), F.lit(1))


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased words; each run of CJK characters by bigrams.

    A run of one CJK character stays a token of its own.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(f"({WORD_NOT_CJK})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(bigrams(r))))
    # texts without CJK take one plain pass over the string
    return F.when(low.rlike(CJK), F.concat(words, grams)).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def normalize_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", ""))


def distinct_ids(ids: Column) -> Column:
    """Ids without blanks, each once, in first-seen order."""
    cleaned = F.transform(ids, lambda i: F.trim(i.cast("string")))
    return F.array_distinct(F.filter(cleaned, lambda i: i.isNotNull() & (i != "")))


def extract_links(content: Column, own_title: Column, valid: Column | None = None) -> Column:
    """Titles written as [[Title]]: trimmed, not blank, not the page itself, each once.

    ``valid`` is an array of the titles of the same base (normalised); when given,
    other links are left out.
    """
    raw = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    found = F.filter(
        F.transform(raw, lambda t: F.substring(F.trim(t), 1, 256)),
        lambda t: (t != "") & (normalize_title(t) != normalize_title(own_title)),
    )
    if valid is not None:
        found = F.filter(found, lambda t: F.array_contains(valid, normalize_title(t)))
    return F.array_distinct(found)


def estimate_tokens(text: Column) -> Column:
    """One token per CJK character plus one per blank-separated word of the rest."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    rest = F.regexp_replace(text, CJK, " ")
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda w: w != ""))
    return (cjk + words).cast("long")


def sentences(text: Column, pattern: str = r"(?<=[。！？!?.])\s*|\n+", min_chars: int = 1) -> Column:
    """Trimmed sentence pieces of at least ``min_chars`` characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


# fixed value: punctuation and blanks left out before bigrams are taken
PUNCTUATION = r"""(?U)[\s，。！？；：、,.!?;:"'“”‘’（）()\[\]【】<>《》\-—_/\\]+"""


def bigram_set(text: Column) -> Column:
    """Distinct two-character windows of the text without punctuation and blanks."""
    return F.array_distinct(bigrams(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, "")))


def overlap_share(needle: Column, hay: Column) -> Column:
    """Share of ``needle`` bigrams that occur in ``hay`` bigrams; 0 for an empty needle."""
    return F.when(
        F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(needle)
    ).otherwise(F.lit(0.0))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def snippet(text: Column, keyword: str, around: int = 30, preview: int = 500) -> Column:
    """Text round the first case-insensitive hit, with ``...`` on every cut side.

    Without a hit, the first ``preview`` characters.
    """
    text = F.coalesce(text, F.lit(""))
    at = F.locate(keyword.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + len(keyword) + around, F.length(text) + 1)
    cut = F.concat(
        F.when(start > 1, "...").otherwise(""),
        F.substr(text, start, stop - start),
        F.when(stop <= F.length(text), "...").otherwise(""),
    )
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, preview))
