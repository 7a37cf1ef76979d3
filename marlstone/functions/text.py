"""Text expressions: normal forms, trigrams, token overlap, names, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped at the edges of names, and by keyword queries.
EDGE_STOPWORDS = ("the", "a", "an", "of", "and", "in", "on", "at", "to", "for")


def squeeze(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(squeeze(text), 256)


def normal_name(name: Column) -> Column:
    """Lower case, only a-z, 0-9, blanks and hyphens, without stopwords at the edges."""
    plain = squeeze(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", ""))
    words = "|".join(EDGE_STOPWORDS)
    return squeeze(F.regexp_replace(F.regexp_replace(plain, rf"^(?:(?:{words})(?:\s+|$))+", ""), rf"(?:(?:^|\s+)(?:{words}))+$", ""))


def trigrams(text: Column) -> Column:
    """Distinct padded trigrams of each word of the lower-cased text, as in the usual trigram index."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two trigram arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def words(text: Column) -> Column:
    """All lower-case words in order, with the stems of ``tokens``."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return F.split(F.regexp_replace(plain, r"([a-z0-9]{2,}[a-rt-z0-9])s(?= |$)", "$1"), " ")


def tokens(text: Column) -> Column:
    """Distinct lower-case words, cut to a stem by dropping a plural s of words of four letters and more.

    Whole-text replacements and array functions, which Spark compiles, unlike functions over each element.
    """
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")
    stemmed = F.regexp_replace(plain, r"([a-z0-9]{2,}[a-rt-z0-9])s(?= |$)", "$1")
    return F.array_except(F.split(stemmed, " "), F.array(*map(F.lit, ("", *EDGE_STOPWORDS))))


def host(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def truncate(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def rough_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def strip_namespace(key: Column) -> Column:
    """The key without a leading ``scheme://``."""
    return F.regexp_replace(key, r"^[a-z]+://", "")


def valid_namespace(key: Column) -> Column:
    return key.rlike(r"^(global:|app:|user:[^:]+|project:[^:]+)")


def fact_text(what: Column, when: Column, where: Column) -> Column:
    """``what | When: ... | Where: ...`` with the parts that there are."""
    return F.concat_ws(" | ", what, F.concat(F.lit("When: "), when), F.concat(F.lit("Where: "), where))


def meaningful_name(name: Column) -> Column:
    """False for null, UUIDs, temporary names and generic stems."""
    low = F.lower(F.trim(name))
    bad = low.rlike(r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$") | low.rlike(r"^(tmp|temp)[\W_\d]|^(tmp|temp)$") | low.rlike(r"^(untitled|document|file|note|readme|index|download|image|scan)[\W_\d]*$")
    return F.coalesce(~bad & (F.length(low) > 0), F.lit(False))
