"""Elements of one array, whatever ranges its file is cut into."""

import json
import random
import re

import pytest

from catalogwatch.sources import json_arrays as J
from catalogwatch.sources import readers as R

TEXTS = ["", "a", 'q"uote', "back\\", '\\"', "[", "]}", ",", "{,", "й\U0001f600", '"products":[', "\\\\", "tab\t", "x" * 70]


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 2:
        return rng.choice(TEXTS)
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind < 5:
        return {rng.choice(TEXTS) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def document(rng):
    items = [value(rng) for _ in range(rng.randint(0, 6))]
    form = {"ensure_ascii": rng.random() < 0.5, "indent": rng.choice([None, 1])}
    if rng.random() < 0.4:
        return rng.choice(["", " \n"]) + json.dumps(items, **form), items
    around = {rng.choice(["meta", 'x"products', "links"]) + str(i): value(rng) for i in range(2)}
    whole = {**around, "products": items, "z": {"products": [1, 2], "more": [[3, 4], {"a": [5, 6]}]}, "tail": value(rng)}
    return json.dumps(whole, **form), items


def by_hand(text: bytes, size: int, field: str) -> list[str]:
    """The three passes over ranges, one after another, without Spark."""
    import re
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".json") as f:
        f.write(text)
        f.flush()
        key = re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[')
        inside, depth, states = False, 0, []
        for k in range(-(-len(text) // size)):
            s = J.Scan(J.read_range(f.name, k * size, size), J._escaped_start(f.name, k * size))
            d = s.depth(inside)
            states.append((k, inside, depth, int(d.min(initial=0))))
            inside, depth = inside != bool(s.quotes.sum() % 2), depth + int(d[-1])
        starts = [x for k, i, d, _ in states if (x := J._begin(f.name, k, i, d, size, key))]
        if not starts:
            return []
        start, level, closed = min(starts)
        out = []
        for k, i, d, low in states:
            if (k + 1) * size > start:
                out += [v.decode() for _, v in J._elements(f.name, k, i, d, start, level, size)]
                if (k * size <= start and closed) or (k * size > start and d + low < level):
                    break
        return out


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_gives_the_elements(seed):
    rng = random.Random(seed)
    text, items = document(rng)
    data = text.encode()
    for size in (1, 2, 3, 7, rng.randint(8, 60), len(data), len(data) + 5):
        assert [json.loads(v) for v in by_hand(data, size, "products")] == items, size


def test_files_of_all_kinds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "AHEAD", 16)
    rng = random.Random(1)
    want = {}
    for k in range(12):
        text, items = document(rng)
        (tmp_path / f"{k}.json").write_text(text)
        want[f"{k}.json"] = items
    odd = {"empty.json": "", "blank.json": "  ", "number.json": "5", "object.json": '{"a": {"products": [1]}}', "none.json": '{"products": 7, "x": [1]}', "empty_list.json": "[ ]"}
    for name, text in odd.items():
        (tmp_path / name).write_text(text)
        want[name] = []
    (tmp_path / "broken.json").write_text('{"products": [{"a": 1}, {"b": "cut o')
    want["broken.json"] = [{"a": 1}, '{"b": "cut o']
    rows = J.json_elements(spark, str(tmp_path / "*.json"), "products", chunk_bytes=23).collect()
    got = {name: [] for name in want}
    for r in sorted(rows, key=lambda r: (r["path"], r["at"])):
        try:
            got[r["path"].rsplit("/", 1)[1]].append(json.loads(r["value"]))
        except json.JSONDecodeError:
            got[r["path"].rsplit("/", 1)[1]].append(r["value"])
    assert got == want
    assert J.json_elements(spark, str(tmp_path / "empty.json"), "products").count() == 0


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 30_000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"generated_at": "t", "products": [')
        f.write(", ".join(json.dumps({"url": f"u{i}", "name": 'quo"te \\ [' * (i % 7), "price": str(i), "variations": []}) for i in range(n)))
        f.write('], "after": [[1, 2], {"url": "no"}]}')
    elements = J.json_elements(spark, str(tmp_path / "big.json"), "products", chunk_bytes=1 << 17)
    assert elements.rdd.getNumPartitions() > 1
    rows = R.read_large_products(spark, str(tmp_path / "big.json"), chunk_bytes=1 << 17)
    assert rows.count() == n and rows.where("url = concat('u', price)").count() == n


def test_large_link_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"domain": "x", "links": ["https://a.ru/1", {"url": "https://a.ru/2", "title": "]"}, 7, {"title": "x"}, None]}))
    got = R.read_large_url_map(spark, str(tmp_path / "m.json"), chunk_bytes=11).orderBy("at").collect()
    assert [r["url"] for r in got] == ["https://a.ru/1", "https://a.ru/2"]


def test_ranges_without_the_name_are_not_scanned_for_the_beginning(tmp_path, monkeypatch):
    """Where the array begins is looked for in every range; those that can't hold it cost a search for bytes only."""
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"before": ["x" * 20_000], "products": [{"name": 'He said "a": [{\\' * 20} for _ in range(400)]}))
    size, real, scanned = 8192, J.Scan, []
    name = re.compile(rb'"products"\s*:\s*\[')
    start = path.read_bytes().index(b'"products"') + len('"products": [') - 1
    monkeypatch.setattr(J, "Scan", lambda *a: scanned.append(k) or real(*a))
    found, inside, depth = {}, False, 0
    for k in range(-(-path.stat().st_size // size)):
        if at := J._begin(str(path), k, inside, depth, size, name):
            found[k] = at
        data = real(J.read_range(str(path), k * size, size), J._escaped_start(str(path), k * size))
        inside, depth = bool(data.odd[-1] != inside), depth + int(data.depth(inside)[-1])
    assert found == {start // size: (start, 2, False)}
    # The first range, where a bare list would begin, the one with the name, and the next if the name is close to its end.
    assert set(scanned) <= {0, start // size, start // size + 1} and k > 10
