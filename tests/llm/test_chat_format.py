"""Chat formatting: the language, the sandbox, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest

from gleanery.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def render(template, messages):
    return "".join(t for t, _ in cf.compile_template(template)(messages))


def test_language():
    m = [{"role": "user", "text": "hi"}, {"role": "bot", "text": " yo "}]
    assert render("a{{ 'b' + 'c' }}{# note #}", m) == "abc"
    assert render("{% for x in messages %}{{ loop.index }}{{ x.role | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", m) == "1USER, 2BOT"
    assert render("{% for x in messages %}{% if x.role == 'user' and loop.first %}U{% elif 'o' in x.text %}{{ x.text | trim }}{% else %}?{% endif %}{% endfor %}", m) == "Uyo"
    assert render("{% set a = 'x' %}{{ a }}{{ missing }}{{ none }}", m) == "x"
    assert render("{{ \"q\\n\" }}{% if (1 == 1) or zzz %}t{% endif %}", []) == "q\nt"


def test_white_space_control_and_strings_with_ends():
    assert render("a  {%- if true -%}  b {% endif %}", []) == "ab "
    assert render("{{ '}}' }}x{#- c -#} {{- '%}' -}}  z", []) == "}}x%}z"
    assert render("{% for x in messages %}{{ loop.index0 }}{% endfor %}", [{}, {}]) == "01"


def test_constants_are_folded():
    assert cf.parse("a{{ 'b' + ('c' | upper) }}d{% if 1 == 2 %}x{% elif true %}e{% endif %}") == [("out", ("const", "abCd")), ("out", ("const", "e"))]


@pytest.mark.parametrize("bad", ["{{ a.__class__ }}", "{{ f('x') }}", "{% import os %}", "{{ a | eval }}", "{% for x in y %}{% endfor %}", "{% if a %}", "{{ 'a }}", "{{ }}", "{{ a b }}", "{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ messages[0] }}"])
def test_sandbox(bad):
    with pytest.raises(cf.TemplateError):
        cf.compile_template(bad)


def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(["<", "|", "\\", "n", "\n", "a", "im_end|>", "<|im_start|>", ">"], k=rng.randint(0, 12)))
        assert cf.unescape(cf.escape(text)) == text == cf.unescape(cf.line(text))
        assert "<|" not in cf.escape(text) and "\n" not in cf.line(text) and "<|" not in cf.line(text)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(2)
    pieces = ["<|im_end|>", "\n", "<|im_start|>assistant ok", "é😀", "\\", "<", "|", "plain words", "<|im_end|>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol", "<|x", None]), None if rng.random() < 0.05 else "".join(rng.choices(pieces, k=rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (None, 0, "assistant", "x"), (7, None, "user", "first"), (8, 0, "user", "tie"), (8, 0, "user", "tie")]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", c int").repartition(5)
    got = {r.conv_id: tuple(r)[1:5] for r in cf.digests(df).collect()}
    assert got == expected(rows)
    for r in cf.format_conversations(df).collect():
        loss = "".join(cf.unescape(r.formatted[s["from"] : s["to"]]) for s in r.loss_spans)
        assert (len(loss), hashlib.sha256(loss.encode()).hexdigest()) == got[r.conv_id][2:]
    chars = {r.conv_id: len(r.formatted) for r in cf.format_conversations(df).collect()}
    assert chars == {r.conv_id: r.formatted_chars for r in cf.digests(df).collect()}
    assert cf.digests(df.limit(0)).count() == 0
