"""Centroid clusters, repaired conversations and repeated strings against brute force, with nulls, ties and empty tables."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from catalogwatch.llm import centroids, repeats, turns

VECTORS = "vec_id long, embedding array<float>, cluster string, v string, lead int"


def brute_clusters(rows, k, rounds, width):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [list(v) for _, v in sorted(kept, key=name)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for i, vs in own.items():
            cents[i] = [sum(col) // len(vs) for col in zip(*vs)]
    done = [(vec_id, near(v)) for vec_id, v in kept]
    by = Counter()
    for _, (d, c) in done:
        by[c] += d
    total = sum(by.values())
    return sorted(
        [(i is None, i or 0, c, d, by[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, (d, c) in done]
    )


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_clusters_equal_brute_force(spark, leading):
    rng = np.random.default_rng(leading)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.4, 6)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 6) for i in range(150)]  # one vector, a third of all rows
    rows += [(7, [1.0] * 6), (7, [0.5] * 6), (None, [2.0] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5)]
    rows += [(904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6), (906, [-1e-9] * 6), (907, [0.0] * 6)]
    df = spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], VECTORS)
    got, cents = centroids.cluster(df, k=8, rounds=3, width=6, leading=leading)
    have = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect())
    assert have == brute_clusters(rows, 8, 3, 6)
    assert len(cents) == 8


def test_bound_is_never_above_and_rules_out():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-300, 300, (500, 64)) // 8 + rng.integers(-3000, 3000, 64) * (k % 2) for k in range(4)]).astype(np.int64)
    c = v[:: len(v) // 40][:40]
    f = v.astype(float)
    rotation = centroids.Rotation.fit(len(v), f.sum(0), f.T @ f, 16)
    bounds = centroids.lower_bounds(*rotation.apply(v), *rotation.apply(c))
    exact = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert (bounds <= exact).all()
    best, distance, compared = centroids.nearest(v, bounds, c)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < 0.8 * exact.size


def test_clusters_of_few_or_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    got, cents = centroids.cluster(none)
    assert got.collect() == [] and len(cents) == 0
    two, cents = centroids.cluster(spark.createDataFrame([(1, [1.0] * 64, "", "", 0), (2, [2.0] * 64, "", "", 0)], VECTORS))
    assert len(cents) == 2 and {r.distance for r in two.collect()} == {0}
    with pytest.raises(Exception, match="components must stay below"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, "", "", 0)], VECTORS))


def brute_repair(rows):
    """Least cost, then least letters, over all edit sequences; rows are (initial, must go, cut, role, text)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = None
    names = {"u": "user", "a": "assistant"}

    def walk(i, state, cost, letters, out):
        nonlocal best
        if best and cost > best[0] or letters.endswith("III"):
            return
        if i == len(rows) and state in ("", "a"):
            best = min(best or (cost, letters, out), (cost, letters, out))
        if state != "":
            given = "a" if state == "u" else "u"
        else:
            given = "u"
        if cost < 5 * len(rows) + 11:
            walk(i, given, cost + 5, letters + "I", out + [names[given] + ":"])
        if i < len(rows):
            initial, must, cut, role, text = rows[i]
            walk(i + 1, state, cost + 2, letters + "D", out)
            if not must:
                if (state, initial) in after:
                    walk(i + 1, after[state, initial], cost + 5 * cut, letters + "K", out + [f"{role}:{text}"])
                for x in "ua":
                    if (state, x) in after:
                        walk(i + 1, after[state, x], cost + 1 + 5 * cut, letters + "R", out + [f"{names[x]}:{text}"])

    walk(0, "", 0, "", [])
    return best


def brute_report(rows):
    """Of one conversation's rows (turn, role, text) in order."""
    seen, marks, counts = set(), [], Counter()
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        core = text.strip(" \t\n\x0b\x0c\r")
        blank, again = not core, (role, text) in seen
        cut = not blank and not again and core[-1] not in ".!?"
        counts["blank"] += blank
        counts["duplicate"] += again and not blank
        counts["truncated"] += cut
        seen.add((role, text))
        marks.append((role[:1], blank or again, cut, role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    cost, audit, out = brute_repair(marks) if marks else (0, "", [])
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), out


TURNS = "conv_id long, turn long, role string, text string, d1 int, present boolean"


def order(rows):
    fill = lambda x: " " if x is None else x
    return sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], fill(r[1]), fill(r[2])))


def test_repair_equals_all_edit_sequences(spark):
    rng = np.random.default_rng(5)
    said = ["Hi.", "Yes!", "Why?", "no end", "", " \t", None, "Hi. ", "é.", "…", "x. "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "u2"]
    convs = {}
    for c in range(150):
        n = int(rng.integers(1, 7))
        convs[c if c else None] = [
            (None if rng.random() < 0.1 else int(rng.integers(0, 8)), roles[rng.integers(0, len(roles))], said[rng.integers(0, len(said))]) for _ in range(n)
        ]
    data = [(c, *r, 1, False) for c, rows in convs.items() for r in rows]
    df = spark.createDataFrame(data, TURNS).repartition(5)
    plans = turns.repair(df).cache()
    got = {r[0]: tuple(r)[1:] for r in plans.collect()}
    rows = {}
    for r in sorted(turns.repaired_rows(df, plans).collect(), key=lambda r: r.place):
        rows.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert set(got) == set(convs)
    for c, own in convs.items():
        want, out = brute_report(order(own))
        assert got[c] == want, (c, order(own))
        assert rows.get(c, []) == out, (c, order(own), got[c])


def test_long_conversations_write_their_pointers(tmp_path):
    letters = "".join(np.random.default_rng(2).choice(list("suatx"), 500))
    results = []
    for held in (7, 1 << 20):
        r = turns.Repair(f"file://{tmp_path}", held)
        for k, x in enumerate(letters):
            r.row({"s": "system", "u": "user", "a": "assistant"}.get(x, x), f"text {k}.", turns._steps(x, k % 9 == 0, k % 7 == 0))
        results.append((len(r.files) > 0, r.finish()))
    assert results[0][0] and not results[1][0] and results[0][1] == results[1][1]


def test_damage_and_empty_conversations(spark):
    import zlib

    data = [(c, t, "assistant", "A. b!", 1, None) for c in range(12) for t in (None, 0, 1, 2, 3)] + [(None, 1, None, None, 1, True)]
    df = spark.createDataFrame(data, TURNS)
    have = Counter((r.conv_id, r.turn, r.role, r.text, r.present) for r in turns.damage(df).collect())
    want = Counter()
    for c, t, role, text, _, _ in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text)
        want[c, t, "user" if kind == 4 else role, text, kind != 0] += 2 if kind == 3 else 1
    assert have == want
    gone = turns.repair(spark.createDataFrame([(4, 1, "user", "Hi.", 1, False)], TURNS), present="present").collect()
    assert [tuple(r) for r in gone] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], TURNS)
    assert turns.repair(turns.damage(empty), present="present").collect() == []
    assert turns.repaired_rows(empty, turns.repair(empty)).collect() == []


def strings(texts, span):
    return Counter(t[k : k + span] for t in texts for k in range(len(t) - span + 1))


def brute_repeats(texts, span):
    count = strings(texts, span)
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 2, int)
        for k in range(len(t) - span + 1):
            if count[t[k : k + span]] > 1:
                covered[k + 1] += 1
                covered[k + 1 + span] -= 1
        on = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered[1:-1]) > 0).astype(int), [0]))))
        out.append(list(zip(on[::2].tolist(), on[1::2].tolist())))
    return out


def test_family_finds_every_repeated_string():
    rng = np.random.default_rng(1)
    for _ in range(120):
        span, n = int(rng.integers(1, 12)), int(rng.integers(1, 20))
        texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(span, span + 40))).astype(np.uint8)) for _ in range(n)]
        family, found = repeats.Family(span), set()
        for at in range(0, n, 2):
            own, places = family.add(texts[at : at + 2], np.arange(at, min(n, at + 2)))
            found |= set(zip(own.tolist(), places.tolist()))
        count = strings(texts, span)
        assert found == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - span + 1) if count[t[k : k + span]] > 1}
        assert len(family.levels) <= 5


def test_anchors_hang_on_the_string_alone():
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 100, 90).astype(np.uint8)
    for _ in range(30):
        before, behind = (rng.integers(97, 100, int(rng.integers(0, 3000))).astype(np.uint8) for _ in "ab")
        x = np.concatenate((before, piece, behind))
        runs, at = repeats.Runs(x, np.array([len(x)]), 90), len(before)
        k = np.searchsorted(runs.first, at, side="right") - 1
        alone = repeats.Runs(piece, np.array([90]), 90)
        assert runs.anchor[k] - at == alone.anchor[0] and runs.last[k] >= at


DOCS = "doc_id long, text string, k1 string, kept int, h int"


@pytest.mark.parametrize("sizes", [{}, {"contexts_of_anchor": 1}, {"batch_bytes": 300, "family_bytes": 900}], ids=["plain", "crowded", "batches"])
@pytest.mark.parametrize("span", [7, 400])
def test_repeats_equal_brute_force(spark, span, sizes, monkeypatch):
    rng = np.random.default_rng(span)
    base = [bytes(rng.integers(97, 100 if span < 50 else 122, int(rng.integers(0, 4 * span))).astype(np.uint8)).decode() for _ in range(40)]
    docs = ["".join(base[j][int(rng.integers(0, 20)) :] for j in rng.integers(0, 40, 3)) for _ in range(100)]
    common = base[0] + "x" * span
    docs += [base[int(rng.integers(1, 40))] + common + base[int(rng.integers(1, 40))] for _ in range(50)]  # a passage of a third of all rows
    docs += [docs[3]] * 4 + ["", None, None, "a" * 50, "a" * 1000, "ab" * 900, "é" * 500, "\U0001f600" * 300, "y" * (span - 1), "z" * span]
    df = spark.createDataFrame([(i if i else None, d, "", 0, 0) for i, d in enumerate(docs)], DOCS).repartition(3)
    got = {r.doc_id or 0: r for r in repeats.remove_repeats(df, span=span, **sizes).collect()}
    want = brute_repeats([(d or "").encode() for d in docs], span)
    assert len(got) == len(docs)
    for i, runs in enumerate(want):
        assert [(x.start, x.stop) for x in got[i].removed] == runs, i
        data = (docs[i] or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[y for _, y in runs]], [*[x for x, _ in runs], len(data)]))
        assert (got[i].n_bytes, bytes(got[i].kept)) == (len(data), kept)


def test_repeats_of_a_text_longer_than_a_block():
    rng = np.random.default_rng(9)
    n, span = repeats.BLOCK + 5000, 400
    lengths = np.array([300, n, 20, 2 * repeats.BLOCK + 10])
    seen = {}
    for a, b, skip, size in repeats._blocks(lengths, span):
        if b - a == 1 and lengths[a] > repeats.BLOCK:
            seen.setdefault(a, []).extend(range(skip, skip + size - span + 1))
    assert {k: v == list(range(lengths[k] - span + 1)) for k, v in seen.items()} == {1: True, 3: True}
    x = rng.integers(0, 256, 5000).astype(np.uint8)
    hashes = repeats.gram_hashes(x, 50)
    again = repeats.gram_hashes(x[1234:], 50)
    assert (hashes[1234:] == again).all() and len(set(hashes.tolist())) == len(hashes)


def test_no_documents(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_merged_intervals():
    for n in range(4):
        for cut in itertools.product(range(4), repeat=2 * n):
            pairs = [(a, a + 1 + b) for a, b in zip(cut[::2], cut[1::2])]
            starts, stops = repeats.merged(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
            covered = {x for a, b in pairs for x in range(a, b)}
            assert {x for a, b in zip(starts, stops) for x in range(a, b)} == covered
            assert all(x < y for x, y in zip(stops.tolist(), starts.tolist()[1:]))
