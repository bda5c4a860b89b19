"""Text, hashing, stemming and HTML functions."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import hashing, html, stem, text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())).select(column(*map(F.col, names))).first()[0]


def test_tokens(spark):
    assert one(spark, text.terms, t="The Cat, a DOG2 café_x naïve über-cool") == ["cat", "caf", "ber", "cool"]
    assert one(spark, lambda t: text.letter_words(t, []), t="café-quality 3x") == ["caf", "quality", "x"]
    assert one(spark, text.query_tokens, t='The "red rose", of a bush!') == ["red", "rose", "bush"]
    assert one(spark, text.query_phrases, t='a "Red Rose" and "x"') == ["red rose", "x"]
    assert one(spark, lambda t: text.ngrams_upto(F.split(t, " "), 3), t="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, lambda t: text.ngrams(F.split(t, " "), 3), t="a b") == []


def test_rounding_is_of_the_exact_value(spark):
    assert one(spark, lambda x: text.to_fixed(x, 2), x=227.015) == 227.01
    assert one(spark, lambda x: text.to_fixed(x, 2), x=1234567.5) == 1234567.5


@pytest.mark.parametrize(("term", "prefix", "shard", "pair"), [("the", "the", "th", "other"), ("th", "th", "th", "other"), ("abc", "ab", "ab", "ab"), ("x", "x", "other", "other"), ("", "aa", "other", "other"), (None, "aa", "other", "other"), ("éa", "éa", "other", "other")])
def test_shards(spark, term, prefix, shard, pair):
    assert (one(spark, text.smart_prefix, t=term), one(spark, text.shard_key, t=term), one(spark, text.pair_shard_key, t=term)) == (prefix, shard, pair)


def test_keys_and_formats(spark):
    assert one(spark, text.safe_key, t="a.b/c-d_e") == "a_b_c-d_e" and one(spark, text.strip_prefix, t="prefix-ab") == "ab"
    times = [one(spark, text.format_time, x=float(v)) for v in (999, 1500, 90000, 5400000)]
    sizes = [one(spark, text.format_bytes, x=float(v)) for v in (12, 2048, 3 << 20, 5 << 30)]
    assert times == ["999ms", "1.50s", "1.50m", "1.50h"] and sizes == ["12B", "2.00KB", "3.00MB", "5.00GB"]


def test_stopword_files(tmp_path):
    (tmp_path / "s.txt").write_text("\nthe\n and \nthe\n")
    assert text.load_stopwords(str(tmp_path / "s.txt")) == ["and", "the"]


def test_placements(spark):
    nodes = [(f"127.0.0.{i}", 9000 + i) for i in range(1, 6)]
    keys = [f"key {i} \"quoted\" é" if i % 7 == 0 else f"key{i}" for i in range(80)]
    nids = sorted(hashlib.sha256(json.dumps({"ip": ip, "port": port}, separators=(",", ":")).encode()).hexdigest() for ip, port in nodes)
    got = {r.key: r for r in hashing.placements(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(nodes, "ip string, port int")).collect()}
    for key in keys:
        kid = hashlib.sha256(json.dumps(key, ensure_ascii=False).encode()).hexdigest()
        assert got[key].kid == kid
        assert got[key].naive == nids[int(kid, 16) % len(nids)]
        assert got[key].consistent == next((n for n in nids if n >= kid), nids[0])
        assert got[key].rendezvous == max(nids, key=lambda n: hashlib.sha256(f'"{kid}{n}"'.encode()).hexdigest())


# Stems of the published algorithm.
STEMS = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled", motoring="motor", sing="sing",
    conflated="conflat", troubled="troubl", sized="size", hopping="hop", falling="fall", hissing="hiss", filing="file", happy="happi", sky="sky", relational="relat",
    conditional="condit", rational="ration", digitizer="digit", operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", formality="formal",
    triplicate="triplic", formative="form", formalize="formal", electrical="electr", goodness="good", revival="reviv", allowance="allow", inference="infer", adjustable="adjust",
    replacement="replac", adoption="adopt", communism="commun", activate="activ", effective="effect", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll",
    walking="walk", easily="easili", fairly="fairli", ran="ran", be="be",
)


def test_stems(spark):
    assert {w: stem.stem(w) for w in STEMS} == STEMS
    df = spark.createDataFrame([(list(STEMS),), (None,), ([None, "cats"],)], "w array<string>")
    assert [r[0] for r in df.select(stem.stem_all("w")).collect()] == [list(STEMS.values()), None, [None, "cat"]]


def test_html():
    page = '<html><head><title>no</title><style>p{}</style></head><body><h1>Big news</h1><p>Hello <a href="x.html">there</a>  now<br>next</p><script>var a="<p>";</script><ul><li>one<li>two</ul></body></html>'
    assert html.page_text(page) == "BIG NEWS\nHello there [x.html] now\nnext\n* one\n* two"
    assert html.plain_text(page) == "Big news Hello there now next one two"
    anchors = '<a href="">a</a><a href="?q=1">b</a><a href="/root">c</a><a href="../up">d</a><a name="n">e</a><a href="javascript:void(0)">f</a><!-- <a href="no">x</a> --><script>"<a href=no>"</script><a href="//h.org/p">g</a>'
    assert html.resolved_links(anchors, "http://site.org/a/index.html") == ["http://site.org/a/", "http://site.org/a/?q=1", "http://site.org/root", "http://site.org/up", "javascript:void(0)", "http://h.org/p"]
    assert html.resolved_links(None, None) == [] and html.page_text(None) == ""


def test_taxonomy_and_scope(spark):
    from gleanery import fixtures as fx

    got = html.taxonomy(fx.SPECIES_HTML)
    assert got == {"hierarchy": [{"label": "kingdom", "value": "plantae"}, {"label": "order", "value": "rosales"}, {"label": "family", "value": "rosaceae"}], "binomial_name": "Rosa rubra"}
    assert html.taxonomy(None) == {"hierarchy": [], "binomial_name": None}
    kept = spark.createDataFrame(fx.LINKS, "link string").where(html.in_scope(F.col("link")))
    assert [r.link for r in kept.collect()] == ["/wiki/Rose", "/wiki/Rose.Jpg", "/wiki/Moss"]
