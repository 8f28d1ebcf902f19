"""Object literals of scripts become the JSON they stand for, whatever code surrounds them."""

import json
import random
import time

import pytest

from catalogwatch.operators import literals as L

WORDS = ["a", "b c", "it's", 'say "x"', "{[(", "й ", "\\", "\U0001f600", "", "</x>", "OFFERS: ["]


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 5)
    if kind < 2:
        return rng.choice(WORDS)
    if kind < 4:
        return rng.choice([0, 7, -3, 12.5, 1e20, -0.25])
    if kind < 6:
        return rng.choice([True, False, None])
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["k", "a-b", "$x", "1", "й", "k2"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def written(rng, v):
    """A value in one of the many ways in which scripts write it."""
    gap = rng.choice(["", " ", "\n", "/* {'} */", "// it's {\n"])
    if v is None:
        return gap + rng.choice(["null", "undefined", "void 0"])
    if v is True or v is False:
        return gap + rng.choice(["true", "!0"] if v else ["false", "!1"])
    if isinstance(v, (int, float)):
        return gap + (rng.choice([str(v), hex(v)]) if isinstance(v, int) and v >= 0 else repr(v))
    if isinstance(v, str):
        quote = rng.choice("'\"`")
        out = "".join(
            "\\" + c if c in (quote, "\\") else rng.choice([c, f"\\u{ord(c):04x}", f"\\u{{{ord(c):x}}}"]) if ord(c) < 65536 else c for c in v
        )
        return gap + quote + out + quote
    if isinstance(v, list):
        tail = "," if v and rng.random() < 0.3 else ""
        return gap + "[" + ",".join(written(rng, x) for x in v) + tail + gap + "]"
    names = [k if k.replace("$", "").replace("й", "").isidentifier() and (k == "OFFERS" or rng.random() < 0.5) else written(rng, k).strip() for k in v]
    tail = "," if v and rng.random() < 0.3 else ""
    return gap + "{" + ",".join(n + gap + ":" + written(rng, x) for n, x in zip(names, v.values())) + tail + "}"


@pytest.mark.parametrize("seed", range(300))
def test_any_way_of_writing_gives_the_json(seed):
    rng = random.Random(seed)
    held = {"id": value(rng), "OFFERS": [value(rng), value(rng)], "more": value(rng)}
    text = written(rng, held)
    assert json.loads(L.scan(text)[1]) == held
    code = f"var q = /[/']{{/.test(s) ? 'it\\'s' : {{}}; function f(a) {{ if (a < 1) {{ return new Shop({text}, function () {{ x = {{}}; }}); }} }} BX.message({{a: b}});"
    found = L.listings(code)
    assert [json.loads(x) for x in found] == [held]


def test_outer_literal_wins_and_code_lets_the_inner_one_out():
    one = L.listings("x({'variants': [{'variants': [1]}]})")
    assert [json.loads(x) for x in one] == [{"variants": [{"variants": [1]}]}]
    two = L.listings("x({a: {'variants': [1]}, b: {variants: [2]}}); y = {variants: [3],}")
    assert [json.loads(x) for x in two] == [{"variants": [1]}, {"variants": [2]}, {"variants": [3]}]
    assert [json.loads(x) for x in L.listings("{ foo(); var x = {variants: [1]}; }")] == [{"variants": [1]}]


def test_expressions_are_left_out_of_a_literal():
    got = L.listings("f({ID: obj.id, N: 'a' + b, C: g({}), D: c ? 1 : 2, E: -x, F: function () { return 1; }, G: (1), variants: [1, x, , 2 + 3, 4], ID2: 'ok'})")
    assert [json.loads(x) for x in got] == [{"variants": [1, None, None, None, 4], "ID2": "ok"}]


def test_last_of_two_equal_names_counts_and_numbers_keep_their_digits():
    assert L.scan("{a: 1, b: 007.50, a: .5, c: 5., d: 12345678901234567890, e: 0xFF, f: +3, g: 1E5}")[1] == (
        '{"a":0.5,"b":7.50,"c":5,"d":12345678901234567890,"e":255,"f":3,"g":1e5}'
    )
    assert json.loads(L.scan("{a: 1, a: x, variants: []}")[1]) == {"variants": []}


def test_text_halves_and_escapes():
    assert L.text_of(r"'😀\x41\u{1F600}\'\q\
b'") == "\U0001f600A\U0001f600'qb"
    assert L.text_of(r"'\ud83d!'") == "�!"


def test_odd_brackets_and_broken_scripts():
    for text in ("{", "}", ")({[", "{variants: [1, {", "variants: ]}", "'", "/*", "`${a}`", "{a:b:c}", "{variants: }", "{variants: [-]}", "{,}", "[,]", "{a 1}"):
        L.listings(text + " variants: ")
    assert L.listings("if (x) { variants: [1] ") == []
    assert [json.loads(x) for x in L.listings("a) }; y({variants: [1]})")] == [{"variants": [1]}]
    assert [json.loads(x) for x in L.listings("f(({[ y({variants: [1]})")] == [{"variants": [1]}]


@pytest.mark.parametrize("text", ["{a:" * 40_000, "[" * 100_000, "({[" * 30_000, "}" * 100_000, "/*" * 50_000, "'" * 100_001, "{'variants':[" * 20_000, "a" * 300_000, "`${" * 40_000])
def test_time_follows_the_length(text):
    start = time.perf_counter()
    L.scan("variants: " + text)
    assert time.perf_counter() - start < 5


def test_attribute_payloads():
    assert L.to_json("{variants: [{id: 1,},]}") == '{"variants":[{"id":1}]}'
    assert L.to_json('{"a": 1.50}') == '{"a": 1.50}'
    assert L.to_json("plain") == "plain" and L.to_json("{not json") == "{not json"
