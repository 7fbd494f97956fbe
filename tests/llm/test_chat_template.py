import hashlib
import random

import pytest

from terrastrata.llm import chat_template as T


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_query_reads_back_every_turn(spark, saved):
    r = random.Random(8)
    bits = ["\\", "#", "###", "</turn>", "<", "/turn>", ":", "\n", "é", "😀", "ok ", "### assistant:\n", "{{ x }}", "{% if %}"]
    convs = {c: [(r.choice(["user", "assistant", "system", "odd: \\role\n", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 30)))])) for _ in range(r.randint(1, 8))] for c in range(60)}
    convs[60] = [("user", "x" * 300_000), ("assistant", "\\" * 100_000)]
    rows = [(c, k, role, text, 1) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    d = saved(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int"))
    df = T.op9_chat_formatting(spark, d)
    assert df.columns[:6] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = {x.conv_id: x for x in df.collect()}
    said = r"\### Assistant: </turn> ok"
    convs[-7] = [("user", said), ("assistant", said)]
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        assert tuple(got[c])[1:5] == brute(turns), c
        assert got[c].formatted_chars == len(T.compiled(T.TEMPLATE)([{"role": a or "", "text": b or ""} for a, b in turns])[0])


def test_ties_nulls_and_no_rows(spark, saved):
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (5, 0, "assistant", "z"), (5, 0, "assistant", "z"), (5, 0, "assistant", "a")]
    got = {x.conv_id: x for x in T.op9_chat_formatting(spark, saved(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert tuple(got[None])[1:5] == brute([("user", "a"), ("user", "b")])
    assert tuple(got[5])[1:5] == brute([("assistant", "a"), ("assistant", "z"), ("assistant", "z")])
    empty = saved(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [x.conv_id for x in T.op9_chat_formatting(spark, empty).collect()] == [-7]


def test_language():
    r = T.compiled("{% for m in messages %}{% if loop.first and m.role == 'system' %}S{% elif m.role != 'user' or false %}{% generation %}{{ m.text | trim | upper }}{% endgeneration %}{% else %}{{ loop.index0 + 1 }}{{ 'a' + 'b' }}{% endif %}{% endfor %}")
    assert r([{"role": "system", "text": "x"}, {"role": "user", "text": "y"}, {"role": "assistant", "text": " z "}]) == ("S2abZ", [(4, 5)])


def test_folding_leaves_one_constant():
    assert T.fold(T.parse("a{{ 'b' + 'c' | upper }}{% if not (1 == 2) %}d{% else %}{{ x }}{% endif %}{{ '' }}")) == (T.Print(T.Const("abCd")),)


@pytest.mark.parametrize("bad", ["{% for m in messages %}", "{{ m.__class__ }}", "{{ open('x') }}", "{{ a | eval }}", "{% import os %}", "{{ 1 + }}", "{% endif %}", "{{ (a }}", "{% if a %}" * 60 + "{% endif %}" * 60])
def test_sandbox_refuses(bad):
    with pytest.raises(T.TemplateError):
        T.compiled(bad)
