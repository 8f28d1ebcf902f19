import hashlib

import pytest

from catalogwatch.llm import chat


def rendered(source, **env):
    return "".join(text for text, _, _ in chat.compile_template(source)(env))


def test_language():
    assert rendered("a{{ x }}b{% if x == 'q' %}1{% elif not y %}2{% else %}3{% endif %}", x="q") == "aqb1"
    assert rendered("{% if x == 'q' %}1{% elif not y %}2{% else %}3{% endif %}", x="z", y=True) == "3"
    assert rendered("{% for m in ms %}{{ loop.index }}:{{ m.t|upper|trim }};{% endfor %}", ms=[{"t": " a"}, {"t": None}]) == "1:A;2:;"
    assert rendered("{{ 'a' ~ 1 ~ none }}{{ missing.key }}{{ (x and 'y') or 'n' }}", x=0) == "a1n"
    assert rendered("{{ m.__class__ }}{{ m.keys }}", m={"a": 1}) == ""  # keys of mappings only, nothing of Python


def test_folding():
    ops = chat._operations(chat.CONTROLS)
    tree = chat.fold(chat.parse("a{{ 'b'|upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{# #}"), ops)
    assert tree == [("text", "aBc{# #}")]
    assert chat.fold(chat.parse("{% if false %}x{% endif %}"), ops) == []


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ }}", "{{ a b }}", "{{ x|system }}", "{% for in y %}{% endfor %}", "{% import os %}", "{{ f(x) }}"])
def test_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


HARD = ["", "plain", "\\", "</turn>", "\\</turn>", "<turn><text>", "a\nb", "\\\\<text>\\", "<tur", "é😀</turn></turn>"]


def test_escape_is_reversible():
    escape, plain = chat.escaper(chat.CONTROLS)
    for text in HARD:
        assert plain(escape(text)) == text
        assert not any(c in escape(text).replace("\\<", "") for c in chat.CONTROLS)


def test_parts_hold_whole_turns():
    messages = [{"role": "user", "text": t} for t in HARD * 3]
    pieces = chat.compile_template(chat.TEMPLATE)({"messages": iter(messages)})
    parts = list(chat.parts(pieces, most=30))
    assert len(parts) > 3
    assert [t for text, _ in parts for _, t in chat.read_turns(text)] == HARD * 3


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 200)
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD * 2)]
    rows += [(2, 0, None, None), (2, 0, None, None), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (None, None, "user", "x"), (4, 2, "as\nsistant<text>", "r")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r.asDict() for r in chat.read_back(made).collect()}
    assert made.where("conv_id = 1").count() > 1
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
