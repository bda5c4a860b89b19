"""License scans against brute-force containment."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleanery.llm import license_scan as ls

SCHEMA = "doc_id long, text string"


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def test_exact_notices_and_clean_texts(spark):
    rng = random.Random(1)
    rows, planted = [], {}
    names = sorted(ls.TEMPLATES)
    for i in range(120):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 150))]
        held = rng.sample(names, k=rng.choice([0, 0, 1, 2]))
        for name in held:
            at = rng.randint(0, len(words))
            words[at:at] = [ls.TEMPLATES[name].upper() if rng.random() < 0.3 else ls.TEMPLATES[name]]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
        planted[i] = set(held)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", template string, row double").repartition(3)
    found = asked = 0
    got = {}
    for r in ls.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.template] = (r.containment, r.start_word)
    for i, text in rows:
        words = plain_words(text)
        expected = {}
        for name, body in ls.TEMPLATES.items():
            t = plain_words(body)
            size = min(5, len(t))
            need, have = set(shingles(t, size)), shingles(words, size)
            # the best run of as many shingles as the widest window
            span = 2 * ls._class_of({"shingles": list(need)})
            best = max((len(need & set(have[s : s + span])) / len(need) for s in range(max(1, len(have) - span + 1))), default=0)
            if best >= ls.MIN_CONTAINMENT:
                expected[name] = best
        assert planted[i] <= set(got.get(i, {})) <= set(expected), i
        found, asked = found + len(got.get(i, {})), asked + len(expected)
        for name in planted[i]:
            containment, start = got[i][name]
            t = plain_words(ls.TEMPLATES[name])
            assert containment == 1.0 and tuple(words[start : start + min(5, len(t))]) in shingles(t, min(5, len(t)))
    assert found >= 0.97 * asked > 60


def test_recall_near_the_threshold_against_brute_force(spark):
    """Notices with so many changed words that some keep 0.8 of their shingles and some do not, in texts and windows of any place."""
    rng = random.Random(3)
    bodies = {name: plain_words(ls.TEMPLATES[name]) for name in ("mit-terms", "bsd-disclaimer", "gpl-warranty", "mit-grant", "gpl-notice")}
    rows, expected = [], set()
    for i in range(150):
        name = rng.choice(sorted(bodies))
        words = list(bodies[name])
        for _ in range(rng.randint(0, max(2, len(words) // 22))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        text = [f"a{rng.randrange(999)}" for _ in range(rng.randint(0, 300))] + words + [f"b{rng.randrange(999)}" for _ in range(rng.randint(0, 300))]
        rows.append((i, " ".join(text)))
        have = set(shingles(text, 5))
        for other, body in bodies.items():
            need = set(shingles(body, 5))
            if len(need & have) >= ls.MIN_CONTAINMENT * len(need):
                expected.add((i, other))
    got = {(r.doc_id, r.template) for r in ls.scan(spark.createDataFrame(rows, SCHEMA).repartition(3), {n: ls.TEMPLATES[n] for n in bodies}).collect()}
    assert got <= expected and len(got) >= 0.97 * len(expected) > 60


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "my-license.txt").write_text("You may use this text\nfor any purpose whatever.")
    assert ls.load_templates(spark, str(tmp_path)) == {"my-license": "You may use this text\nfor any purpose whatever."}


def test_edited_notices_are_found(spark):
    rng = random.Random(2)
    body = plain_words(ls.TEMPLATES["mit-grant"] + " " + ls.TEMPLATES["gpl-notice"])
    rows = []
    for i in range(60):
        words = body.copy()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join([f"a{rng.randrange(999)}" for _ in range(rng.randint(0, 90))] + words + [f"b{rng.randrange(999)}" for _ in range(50)])))
    got = {r.doc_id for r in ls.scan(spark.createDataFrame(rows, SCHEMA), {"long": " ".join(body)}).collect()}
    assert len(got) >= 59


def test_edges_and_native_plan(spark):
    rows = [(1, None), (2, ""), (3, "All rights"), (None, "all RIGHTS, reserved"), (4, "All rights reserved. " * 20000), (5, "Released under the MIT License."), (5, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ls.scan(df)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(None, "all-rights-reserved", 1.0, 0), (4, "all-rights-reserved", 1.0, 0), (5, "mit", 1.0, 0), (5, "mit", 1.0, 0)], key=str)
    ids = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("Released under the MIT License.").alias("text"))
    assert "ExistingRDD" not in ls.scan(ids)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", ""))
    assert ls.scan(df.limit(0)).count() == 0 and ls.scan(df, {}).count() == 0 and ls.scan(df, {"blank": " ... "}).count() == 0
