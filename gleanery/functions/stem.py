"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), as an Arrow UDF."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix rules of the published algorithm (fixed values).
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """The word as consonants (c) and vowels (v)."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], fits: Callable[[str], bool]) -> str:
    """The longest matching suffix decides, whether or not its condition holds."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if fits(stem) else word
    return word


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of one lower-case word; words under three letters stay."""
    if len(word) < 3:
        return word
    w = _replace(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda s: True)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for suffix in ("ing", "ed"):
            if w.endswith(suffix):
                cut = w[: -len(suffix)]
                if "v" in _shape(cut):
                    w = cut
                    if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _STEP2, lambda s: _measure(s) > 0)
    w = _replace(w, _STEP3, lambda s: _measure(s) > 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            cut = w[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
            w = cut if _measure(cut) > 1 else w
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_arrays(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])


def _stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_col(word: Column | str) -> Column:
    """Stem of one word: for columns of distinct words."""
    return F.pandas_udf(_stem_words, "string")(word)


def stem_all(words: Column | str) -> Column:
    """Stems of arrays of words."""
    return F.pandas_udf(_stem_arrays, "array<string>")(words)
