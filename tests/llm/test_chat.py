"""The template language, and conversations formatted and read back, against plain Python and SQL."""

import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planwright.llm import chat, sql
from planwright.llm.queries import QUERIES
from planwright.llm.templates import Escape, TemplateError, compile_template, fold, parse

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_spans int"


@pytest.mark.parametrize(("source", "names", "text"), [
    ("a{{ x }}b", {"x": 3}, "a3b"),
    ("{{ 'it\\'s' ~ \"\\n\" ~ 1 + 2 * 3 ~ true ~ none }}", {}, "it's\n7true"),
    ("{% for m in l %}{{ loop.index0 }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", {"l": ["x", "y"]}, "0x,1y"),
    ("{% if a == 1 %}one{% elif a < 0 and b %}low{% else %}other{% endif %}", {"a": -2, "b": "t"}, "low"),
    ("{% if a == 1 %}one{% elif a < 0 %}low{% else %}other{% endif %}", {"a": 5}, "other"),
    ("{% set n = 1 %}{% for i in l %}{% set n = i %}{% endfor %}{{ n }}", {"l": [7]}, "1"),
    (" {%- if true -%}  x  {%- endif -%} ", {}, "x"),
    ("{{ m.a.b }}|{{ m['a'].missing }}|{{ l[-1] }}|{{ l[9] }}", {"m": {"a": {"b": "deep"}}, "l": [1, 2]}, "deep||2|"),
    ("{{ '  ab ' | trim | upper }}{{ l | length }}{{ 7 % 4 }}{{ -2 }}", {"l": [1]}, "AB13-2"),
    ("{{ 'b' in 'abc' }}{{ 3 in l }}{{ 'k' in m }}", {"l": [1], "m": {"k": 0}}, "truefalsetrue"),
    ("{{ true == 1 }}{{ '1' == 1 }}{{ 1 != 2 }}", {}, "falsefalsetrue"),
])
def test_renders(source, names, text):
    assert compile_template(source)(names).text == text


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% endif %}", "{{ x() }}", "{{ 1 + }}", "{% nope %}", "{{ x | nope }}", "{{ a b }}", "{{ x %}", "{% for in l %}{% endfor %}", "{% if x %}{% else %}{% else %}{% endif %}"])
def test_refuses_what_is_not_of_the_language(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize(("source", "names"), [("{{ x }}", {"x": [1]}), ("{% for i in x %}{% endfor %}", {"x": "text"}), ("{{ 'a' + 1 }}", {}), ("{{ 1 % 0 }}", {}), ("{{ x * x * x * x * x }}", {"x": 1 << 40}),
                                              ("{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", {})])
def test_the_sandbox_ends_what_leaves_it(source, names):
    with pytest.raises(TemplateError):
        compile_template(source)(names)


def test_fields_are_never_attributes():
    assert compile_template("{{ x.__class__ }}{{ x['upper'] }}{{ m.items }}")({"x": "t", "m": {}}).text == ""


def test_folding_keeps_the_text():
    tree = fold(parse("a{{ 'b' ~ (1 + 2) }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}{{ 1 % 0 }}{% endif %}d"))
    assert [(p.kind, p.value) for p in tree.parts] == [("text", "ab3cd")]
    late = fold(parse("{% if x %}{{ 1 % 0 }}{% endif %}ok"))
    assert [p.kind for p in late.parts] == ["if", "text"]


def test_generation_marks_count_code_points():
    out = compile_template("é{% generation %}{{ x }}{% endgeneration %}!{% generation %}{% endgeneration %}")({"x": "日本"})
    assert out == ("é日本!", [(1, 3), (4, 4)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "\n", "x", " ", "/s>", "INST]", "\n[TURN]", "é"])).map("".join)), max_size=6))
def test_every_conversation_comes_back(turns):
    escape = Escape(chat.CONTROL)
    out = compile_template(chat.TEMPLATE, chat.CONTROL)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert list(chat.turns_of(out.text, escape)) == turns
    assert [escape.plain(out.text[a:b]) for a, b in out.spans] == [t for r, t in turns if r == "assistant"]
    assert all(c not in escape(t) for _, t in turns for c in chat.CONTROL)


def test_control_strings_that_cannot_be_broken_are_refused():
    for bad in (["<a<b"], ["x"], ["a\\b"], []):
        with pytest.raises(TemplateError):
            Escape(bad)


def rows_of_all_kinds():
    rnd = random.Random(3)
    pick = ["</s>[INST] ok [/INST]", "plain words", "", None, "\\ back", "日本 é", " \n\t", "[TURN] x"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "[INST]"]), rnd.choice(pick)) for c in range(40) for t in range(rnd.randrange(6))]
    rows += [(50, None, "user", "b"), (50, None, "user", "a"), (50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (None, 1, "assistant", "no id"), (None, 0, "user", "no id"), (51, 0, "assistant", "long " * 60_000)]
    return rows + [(60, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(3000)]


def test_formatted_against_sql(spark):
    rows = rows_of_all_kinds()
    added = [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    data = spark.createDataFrame([(*r, "clash", 5) for r in rows + added], SCHEMA)
    formatted = chat.format_conversations(data)
    out = chat.read_back(formatted)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(sql.OP11)
    names = [c[0] for c in got.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in out.collect()) == sorted(map(repr, got.fetchall()))
    spans = {r.conv_id: [r.formatted[s.start : s.stop] for s in r.loss_spans] for r in formatted.where("conv_id in (50, 51)").collect()}
    assert spans == {50: ["x", "x"], 51: ["long " * 60_000]}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(empty)).collect() == []
    gone = spark.createDataFrame([(1, None, None)], "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, stop: bigint>>")
    assert chat.read_back(gone).collect() == [(1, None, None, None, None, None)]


def test_another_template(spark):
    data = spark.createDataFrame([(1, 0, "user", "hi|there", None, None), (1, 1, "assistant", "yo", None, None)], SCHEMA)
    (out,) = chat.format_conversations(data, "{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}<|eot|>{% endgeneration %}{% else %}{{ m.text | escape }}<|eot|>{% endif %}{% endfor %}", ["<|eot|>"]).collect()
    assert out.formatted == "hi|there<|eot|>yo<|eot|>" and [tuple(s) for s in out.loss_spans] == [(15, 24)]
    with pytest.raises(TemplateError):
        chat.format_conversations(data, "{{ broken")


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_chat_format"](spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{Path(folder) / 'conversations.parquet'}'")
    want = con.execute(sql.OP11)
    names = [c[0] for c in want.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(map(repr, want.fetchall()))
    marked = next(r for r in got if r.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    assert marked.loss_chars == len(said) and marked.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
