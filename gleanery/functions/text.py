"""Text expressions: tokenising, filtering, shards, n-grams, portable rounding. All are built-in functions."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the query language.
QUERY_STOPWORDS = (
    "a an the and or but is are was were be been being in on at to for with by about against between into "
    "through during before after above below from up down of"
).split()

# Two-letter prefixes that shard by three letters.
COMMON_PREFIXES = ("th", "an", "co", "re", "in", "de", "pr", "st", "en", "tr", "di", "ch", "pe")


def load_stopwords(path: str) -> list[str]:
    """A stop word list of any size, one word a line; blank lines do not count."""
    return sorted({w.strip() for w in Path(path).read_text(encoding="utf-8").splitlines() if w.strip()})


def raw_tokens(text: Column) -> Column:
    """Maximal runs of ``[a-z0-9_]`` of the lower-cased text (no word boundaries: engines differ on them)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def keep_terms(tokens: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """Terms over two letters long, of letters only, and not stop words."""
    stop = sorted(set(stopwords))

    def kept(t: Column) -> Column:
        fits = (F.length(t) > 2) & t.rlike("^[a-z]+$")
        return fits & ~t.isin(stop) if stop else fits

    return F.filter(tokens, kept)


def terms(text: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """``keep_terms(raw_tokens(text))``, by one pattern: letters only, with no token character on either side."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z0-9_])[a-z]{3,}+(?![a-z0-9_])"), F.lit(0))
    stop = sorted(set(stopwords))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def has_term(text: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """Whether ``terms`` of the text has any: a search that ends at the first."""
    stop = "|".join(sorted(w for w in set(stopwords) if w.isascii() and w.isalpha()))
    other = f"(?!(?:{stop})(?![a-z0-9_]))" if stop else ""
    return F.lower(text).rlike(f"(?<![a-z0-9_]){other}[a-z]{{3,}}+(?![a-z0-9_])")


def word_array_terms(words: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """Terms of an array of raw words; the document's length stays ``size(words)``."""
    return keep_terms(F.transform(words, F.lower), stopwords)


def letter_words(text: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """Lower-cased runs of ASCII letters (other letters split words), without stop words."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), lambda w: w != "")
    stop = sorted(set(stopwords))
    return F.filter(parts, lambda w: ~w.isin(stop)) if stop else parts


def query_tokens(query: Column) -> Column:
    """Terms of a search query: over two characters, without stop words."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(query), "[^A-Za-z0-9_\\s]", " ")), "\\s+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(QUERY_STOPWORDS))


def query_phrases(query: Column) -> Column:
    """Lower-cased phrases between double quotes."""
    return F.transform(F.regexp_extract_all(query, F.lit('"([^"]*)"'), F.lit(1)), F.lower)


def ngrams(words: Column, n: int) -> Column:
    """Complete runs of ``n`` words, joined by one space, without a shuffle."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def ngrams_upto(words: Column, n: int = 3) -> Column:
    return F.concat(*(ngrams(words, k) for k in range(1, n + 1)))


def to_fixed(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, as decimal formatting does it (``round`` differs on 227.015).

    Scaled values below 2 ** 31 are off by less than 2.5e-7: those further than that from a tie are rounded as numbers, the rest are formatted.
    """
    scaled = value.cast("double") * float(10**digits)
    certain = (F.abs(scaled) < float(1 << 31)) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(certain, F.rint(scaled) / float(10**digits)).otherwise(F.regexp_replace(F.format_number(value, digits), ",", "").cast("double"))


def smart_prefix(term: Column) -> Column:
    """Two letters, three for common prefixes; ``aa`` for no term."""
    low = F.lower(term)
    two = F.substring(low, 1, 2)
    return F.when(F.coalesce(term, F.lit("")) == "", "aa").when(two.isin(*COMMON_PREFIXES) & (F.length(term) >= 3), F.substring(low, 1, 3)).otherwise(two)


def shard_key(term: Column) -> Column:
    """First two characters where they are ``[a-z0-9]``, else ``other``."""
    low = F.lower(F.coalesce(term, F.lit("")))
    return F.when(low.rlike("^[a-z0-9]{2}"), F.substring(low, 1, 2)).otherwise("other")


def pair_shard_key(term: Column) -> Column:
    """Shards of the alphabet cut into pairs: the term must start with the very pair (ab, cd, ..., 89), so most are ``other``."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    pairs = [alphabet[i : i + 2] for i in range(0, len(alphabet), 2)]
    two = F.substring(F.lower(F.coalesce(term, F.lit(""))), 1, 2)
    return F.when(two.isin(pairs), two).otherwise("other")


def safe_key(key: Column) -> Column:
    """A key with all but letters, digits, ``_`` and ``-`` replaced (lossy: for file names only)."""
    return F.regexp_replace(key, "[^a-zA-Z0-9_-]", "_")


def strip_prefix(key: Column) -> Column:
    return F.regexp_replace(key, "^prefix-", "")


def format_time(ms: Column) -> Column:
    def fixed(x: Column) -> Column:
        return F.format_string("%.2f", x.cast("double"))

    return (
        F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(fixed(ms / 1000), F.lit("s")))
        .when(ms < 3600000, F.concat(fixed(ms / 60000), F.lit("m")))
        .otherwise(F.concat(fixed(ms / 3600000), F.lit("h")))
    )


def format_bytes(size: Column) -> Column:
    def fixed(x: Column) -> Column:
        return F.format_string("%.2f", x.cast("double"))

    return (
        F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit("B")))
        .when(size < 1 << 20, F.concat(fixed(size / 1024), F.lit("KB")))
        .when(size < 1 << 30, F.concat(fixed(size / (1 << 20)), F.lit("MB")))
        .otherwise(F.concat(fixed(size / (1 << 30)), F.lit("GB")))
    )
