"""Quality rules: a learned decision list of threshold conjunctions, as Spark conditional expressions.

Everything that touches documents is built-in DataFrame functions. The features of a text are expressions
over its words; the list is learned by sequential covering from the statistics of at most ``SAMPLE_ROWS``
labelled documents (those with the smallest hash of their id), which the driver gets as numbers:

* *grow*: the conjunction of threshold tests with the best FOIL gain for the rejected class, one test at a
  time, on two thirds of the sample;
* *prune*: tests are dropped from the end as long as the rule's worth on the last third does not fall;
* *cover*: rows under an accepted rule are taken out, and the next rule is grown, until none is precise enough.

The rules become one ordered ``CASE WHEN`` expression; a document that no rule covers is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_name

#: Bound of the labelled rows that training collects.
SAMPLE_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The learner: a rule's precision and rows in the pruning part, and how many rules, tests of a rule and thresholds of a feature it tries.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_TESTS, MAX_THRESHOLDS = 0.85, 4, 12, 3, 48
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")


def _removed(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with one column ``prefix + name`` for each of BASE, and for each ratio of FEATURES."""
    out = docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines, grams, twice = (prefix + "_" + n for n in ("words", "lines", "grams", "twice"))
    out = out.withColumns({
        words: F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""),
        lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size(words)
    gram = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn(grams, F.sort_array(gram))
    at = F.col(grams)
    again = F.filter(at, lambda x, k: F.get(at, k - 1)["h"].eqNullSafe(x["h"]) | F.get(at, k + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn(twice, F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col(twice)
    steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a))
    repeat = F.when(F.size(p) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(steps, F.lit(0), lambda acc, x: acc + x))
    whole = {
        "n_words": n,
        "word_chars": F.char_length(F.translate(text, _SPACE, "")),
        "n_symbols": _removed(text, _SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat,
    }
    more = {
        "n_lines": F.size(lines),
        "n_upper": _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _removed(text, "0123456789"),
        "n_marks": _removed(text, "!?=@_/\\{}[]~^+"),
        "n_distinct": F.size(F.array_distinct(F.col(words))),
    }
    out = out.withColumns({prefix + k: v.cast("bigint") for k, v in (whole | more).items()}).drop(words, lines, grams, twice)

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(prefix + a), F.col(prefix + b)), F.lit(0.0))

    return out.withColumns({
        prefix + "mean_word_chars": share("word_chars", "n_words"),
        prefix + "symbol_share": share("n_symbols", "word_chars"),
        prefix + "dup_line_share": share("n_dup_lines", "n_lines"),
        prefix + "repeat_share": share("n_repeat_words", "n_words"),
        prefix + "upper_share": share("n_upper", "word_chars"),
        prefix + "digit_share": share("n_digits", "word_chars"),
        prefix + "mark_share": share("n_marks", "word_chars"),
        prefix + "distinct_share": share("n_distinct", "n_words"),
    }).drop(*(prefix + k for k in more))


# --- sequential covering ---------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def column(self, prefix: str) -> Column:
        value = F.col(prefix + self.feature).cast("double")
        return value >= self.threshold if self.at_least else value < self.threshold

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for test in rule:
        mask &= test.mask(x)
    return mask


def _thresholds(values: np.ndarray) -> list[float]:
    """Midpoints between neighbouring quantiles of the distinct values."""
    distinct = np.unique(values)
    if len(distinct) > MAX_THRESHOLDS:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, MAX_THRESHOLDS), method="nearest"))
    return ((distinct[1:] + distinct[:-1]) / 2).tolist()


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < MAX_TESTS:
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p0 or not n0:
            break
        base = math.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for feature in FEATURES:
            for threshold in _thresholds(x[feature][covered]):
                for at_least in (True, False):
                    mask = covered & Test(feature, at_least, threshold).mask(x)
                    p = int((mask & bad).sum())
                    if p and (worth := p * (math.log2(p / int(mask.sum())) - base)) > gain:
                        best, gain = Test(feature, at_least, threshold), worth
        if best is None:
            break
        rule += (best,)
        covered &= best.mask(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    mask = _covers(rule, x, len(bad))
    p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: list[tuple[bool, dict[str, float]]]) -> list[Rule]:
    """Rules for rejection, in order, from (is bad, features) of labelled documents."""
    if not rows:
        return []
    bad = np.array([b for b, _ in rows], bool)
    x = {f: np.array([r[f] for _, r in rows], float) for f in FEATURES}
    prune = np.arange(len(rows)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < MAX_RULES:
        g, v = left & ~prune, left & prune
        if not (bad & g).any():
            break
        rule = _grow({f: a[g] for f, a in x.items()}, bad[g])
        xv, bv = {f: a[v] for f, a in x.items()}, bad[v]
        while len(rule) > 1 and _worth(rule[:-1], xv, bv) >= _worth(rule, xv, bv):
            rule = rule[:-1]
        mask = _covers(rule, xv, len(bv)) if rule else np.zeros(len(bv), bool)
        if mask.sum() < MIN_COVER or (mask & bv).sum() < MIN_PRECISION * mask.sum():
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from a bounded sample of the labelled documents; none without labels of both kinds."""
    marked = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.min(quality_col).alias("_quality"))
    sample = marked.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample_rows)
    joined = docs.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc_id") == F.col("_label_id"))
    joined = joined.groupBy("_label_id", "_quality").agg(F.min("_text").alias("_text"))  # an id's rows count once
    features = with_features(joined, "_text").select("_label_id", "_quality", *("_q_" + f for f in FEATURES))
    rows = sorted(features.collect(), key=lambda r: (r["_label_id"] * 2654435761 % 2**32, r["_label_id"]))
    return learn([(r["_quality"] == 0, {f: float(r["_q_" + f]) for f in FEATURES}) for r in rows])


def verdict(rules: list[Rule], prefix: str = "_q_") -> Column:
    """The ordered conditional expression: false under the first rule that covers a row, else true."""
    out = None
    for rule in rules:
        condition = rule[0].column(prefix)
        for test in rule[1:]:
            condition &= test.column(prefix)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _judged(docs: DataFrame, rules: list[Rule], text_col: str, prefix: str) -> DataFrame:
    q = prefix
    featured = with_features(docs, text_col, q)
    failed = (F.col(q + "n_words") < MIN_WORDS) | (100 * F.col(q + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(q + "n_words"))
    # always true, but not deterministic to the optimizer: a filter on the verdict then stays above the
    # features, where pushing it down would repeat their array expressions many times over
    here = F.monotonically_increasing_id() >= 0
    return featured.withColumn(q + "base_failed", here & failed).withColumn(q + "kept", here & ~F.col(q + "base_failed") & verdict(rules, q))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base counts, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules. Rows that repeat an id each get a row; null
    ids are kept. Without usable labels only the base rules reject. Extra columns are ignored.
    """
    rules = learn_from(docs, labels, id_col, text_col) if rules is None else rules
    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return _judged(slim, rules, "text", "_q_").select("doc_id", *(F.col("_q_" + c).alias(c) for c in (*BASE, "base_failed", "kept")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Null and empty texts fail the base rules and go; of rows that repeat, all or none stay; texts of any length are read
    whole. An empty table stays empty, and extra columns are kept whatever their names.
    """
    prefix = fresh_name(docs, "_q_")
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return _judged(docs, learn_from(docs, labels, id_col, text_col), text_col, prefix).where(F.col(prefix + "kept")).select(*docs.columns)
