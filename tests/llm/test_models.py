"""Pieces, token files, languages, n-grams, embeddings, components: against the libraries or plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest

from catalogwatch.llm import embeddings, langid, ngram, pieces, token_files
from catalogwatch.llm.graph import components

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ü", "中", "😀", "<s>", "<0x41>", "<unk>", "<|endoftext|>", "\u00a0", "0", "1.", "'s", "'", "\x00", "\x85", "\r\n", "!", "ö,"]
SCHEMA = "doc_id long, text string, ids int, start string"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(PARTS) for _ in range(rng.choice([1, 2, 3, 8, 30, 200]))) for _ in range(n))]


def test_pieces_equal_the_library():
    own = pieces.coder(PIECES)
    texts = [*odd_texts(3000), "中文" * 5000 + "x" * 20000 + " " * 999]
    assert [own.encode(t).tolist() for t in texts] == [own.library.encode(t) for t in texts]
    assert all(fits == (own.merge(own.names[a] + own.names[b]) == [own.names[a], own.names[b]]) for (a, b), fits in own.pairs.items())


def test_pieces_with_small_stores(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 20)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    own = pieces.PieceCoder(PIECES)
    assert all(own.encode(t).tolist() == own.library.encode(t) for t in odd_texts(300, 2))


def test_encode_decode(spark):
    texts = [None, *odd_texts(40, 3)]
    df = spark.createDataFrame([(i % 7 or None, t, 1, "s") for i, t in enumerate(texts)], SCHEMA)
    got = pieces.encode_decode(df, PIECES).collect()
    lib = pieces.coder(PIECES).library
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter(
        (i % 7 or None, tuple(lib.encode(t or "")), lib.decode(lib.encode(t or ""))) for i, t in enumerate(texts)
    )
    assert pieces.encode_decode(df.limit(0), PIECES).count() == 0


def test_token_coder_equals_the_library(monkeypatch):
    for small in (False, True):
        if small:
            monkeypatch.setattr(token_files, "KEPT_WORDS", 20)
            monkeypatch.setattr(token_files, "KEPT_PARTS", 20)
        own = token_files.TokenCoder(BYTES)
        for t in odd_texts(1500, 4 + small):
            assert np.frombuffer(own.encode(t), "<u2").tolist() == own.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("file_bytes", [1 << 24, 200])
def test_token_files(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    texts = [None, *odd_texts(60, 6)]
    rows = [(i // 2 * 10, t, 1, "s") for i, t in enumerate(texts)] + [(None, "no id", 1, "s"), (70, "again", 1, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    folder, manifest = token_files.write(df, BYTES, documents_per_file=9)
    got = token_files.read(spark, folder, manifest).orderBy("start").collect()
    lib = token_files.TokenCoder(BYTES).library
    want = [(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t, _, _ in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in want), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    uris = [r["uri"] for r in manifest.collect()]
    short = [x.tolist() for u in uris for x in token_files.read_document(folder, u, 70)]
    assert sorted(short) == sorted(x.tolist() for i, x in want if i == 70)
    none, empty = token_files.write(df.limit(0), BYTES)
    assert token_files.read(spark, none, empty).count() == 0


def test_forward_sums_all_segmentations():
    grid = langid.Lattice(PIECES)
    number = {x: i for i, x in enumerate(grid.pieces)}
    p = langid._probabilities(np.random.default_rng(0).random((grid.none + 1, 3)) * 10)

    def segmentations(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            k = number.get(text[:n], grid.unknown if n == 1 else None)
            if k is not None:
                for rest in segmentations(text[n:]):
                    yield (k, *rest)

    words = ["the", "ation", "ü", "中", "x", "üst"]
    weights = np.arange(18.0).reshape(6, 3)
    counts = np.zeros(p.shape)
    for w, weight, score in zip(words, weights, langid.word_scores(grid, words, p)):
        every = list(segmentations(langid.BLANK + w))
        shares = np.array([np.prod(p[list(s)], axis=0) for s in every])
        assert np.allclose(score, np.log(shares.sum(axis=0)))
        for s, share in zip(every, shares / shares.sum(axis=0)):
            for k in s:
                counts[k] += share * weight
    assert np.allclose(counts, langid.expected_counts(grid, words, weights, p))
    long = "ungheit" * 400
    assert np.isfinite(langid.word_scores(grid, [long], p)).all()
    assert np.allclose(langid._long_word(grid.matches(["ungheit"])[0], p), langid.word_scores(grid, ["ungheit"], p))


def test_words_that_underflow():
    """Long words of letters without pieces, against exact decimals."""
    grid = langid.Lattice(PIECES)
    seen = np.random.default_rng(1).random((grid.none + 1, 2)) * [1e3, 1e9]
    seen[grid.unknown] = 0
    p = langid._probabilities(seen)
    words = [*("\ua000" * n for n in (1, 30, 40, 46, 47, 48)), "the" + "\ua001" * 44, "q" * 47, "the"]
    weights = np.arange(2.0, 2 + 2 * len(words)).reshape(-1, 2)
    counts = np.zeros(p.shape)
    exact = []
    for w, weight in zip(words, weights):
        found = grid.matches([w])[0]
        steps = [(t, t + n + 1, k) for t in range(len(found)) for n, k in enumerate(found[t].tolist()) if k != grid.none]
        scores = []
        for lang in range(2):
            there, back = [Decimal(0)] * (len(found) + 1), [Decimal(0)] * (len(found) + 1)
            there[0] = back[-1] = Decimal(1)
            share = {k: Decimal(float(p[k, lang])) for _, _, k in steps}
            for a, b, k in steps:
                there[b] += there[a] * share[k]
            for a, b, k in reversed(steps):
                back[a] += back[b] * share[k]
            for a, b, k in steps:
                counts[k, lang] += float(there[a] * share[k] * back[b] / there[-1]) * weight[lang]
            scores.append(float(there[-1].ln()))
        exact.append(scores)
    assert min(min(x) for x in exact) < -800
    assert np.allclose(langid.word_scores(grid, words, p), exact)
    assert np.allclose(langid.expected_counts(grid, words, weights, p), counts)


def test_scores_of_unknown_letters(spark):
    rows = [(i, f"{w} {w}s", lang) for i, (w, lang) in enumerate([("the cat", "en"), ("der hund", "de"), ("\ua000" * 47, "de")] * 5)]
    model = langid.train(spark.createDataFrame(rows, "key long, text string, lang string"), PIECES)
    assert np.isfinite(model.p).all()
    asked = spark.createDataFrame([(n, ch * n) for n in range(30, 61, 3) for ch in ("\ua000", "\u4dc0", "ж")], "doc_id long, text string")
    got = langid.identify(asked.where("text IS NOT NULL"), model).collect()
    assert len(got) == 33 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.annotate(docs, langid.train_on(docs, PIECES)).where(langid.fold() == 0).collect()
    assert len(said) > 100 and sum(r["lang"] == r["lang_pred"] for r in said) >= 0.98 * len(said)


def test_languages_of_odd_texts(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "12 ²!", "en", "s"), (None, "the dog", None, "s"), (2, "der hund", "de", "s")]
    df = spark.createDataFrame(rows, "key long, text string, lang string, score string")
    model = langid.train(df, PIECES)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model, doc_id="key").collect()]
    assert [x[:2] for x in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (2, "de")]
    assert all(0 <= s <= 1 for _, _, s in got) and got[2][2] == 0
    assert langid.identify(df.limit(0), model, doc_id="key").count() == 0
    nothing = langid.train(df.limit(0), PIECES)
    assert {r["lang_pred"] for r in langid.identify(df, nothing, doc_id="key").collect()} == {"und"}


def kneser_ney(train, docs):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), "</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        x = tokens(t)
        uni.update(x)
        bi.update(zip(["<s>", *x[:-1]], x))
    total, size = sum(uni.values()), len(uni)
    follows, spread = Counter(v for _, v in bi), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in bi.items():
        spread[u][min(c, 3) - 1] += 1
    seen = Counter(uni)
    seen["<s>"] = len(train)
    high = ngram.discounts(*(sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)))
    low = ngram.discounts(*(sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)))
    mass, of = sum(low[min(c, 3)] for c in follows.values()), sum(follows.values())
    lower = lambda v: (max(follows[v] - low[min(follows[v], 3)], 0) + mass / (size + 1)) / of if of else 1 / (size + 1)
    for t in docs:
        x = tokens(t)
        base = score = 0.0
        for u, v in zip(["<s>", *x[:-1]], x):
            base += math.log10((uni[v] + 0.5) / (total + 0.5 * (size + 1)))
            p = lower(v)
            if seen[u]:
                p = (max(bi[u, v] - high[min(bi[u, v], 3)], 0) + sum(a * c for a, c in zip(high[1:], spread[u])) * p) / seen[u]
            score += math.log10(p)
        yield len(x), sum(uni[v] > 0 for v in x), total, base, score


@pytest.mark.parametrize("small", [False, True])
def test_ngrams(spark, monkeypatch, small):
    if small:  # many files, contexts split over several of them, stores that overflow
        for name, value in {"TOKENS_PER_FILE": 300, "WORDS_PER_FILE": 90, "BLOCK": 64, "TOKENS_AT_ONCE": 500, "WORDS_AT_ONCE": 50, "KEPT_WORDS": 120, "MOST": 3}.items():
            monkeypatch.setattr(ngram, name, value)
    rng = random.Random(5)
    words = [f"W{int(rng.paretovariate(0.7)) % 500}" for _ in range(4000)]
    texts = [None, "", " \t", *(" ".join(words[rng.randrange(3900) :][: rng.choice([1, 5, 60])]) for _ in range(250)), "é\u00a0É " * 300]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    model = ngram.train(df.where("doc_id % 3 <> 0"))
    got = [tuple(r)[1:] for r in ngram.score(df, model).orderBy("doc_id").collect()]
    want = list(kneser_ney([t for i, t in enumerate(texts) if i % 3], texts))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in want], rtol=1e-9)
    none = ngram.train(df.limit(0))
    assert [r["n_known"] for r in ngram.score(df.limit(5), none).collect()] == [0] * 5
    assert ngram.score(df.limit(0), model).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 24))
    rows = [c + rng.standard_normal(24) * s for c in centres for s in (0, 0.05, 0.1, 0.2, 0.3, 0.4)]
    rows += [centres[0] + rng.standard_normal(24) * 0.03 for _ in range(700)] + [centres[1] * 3] * 40
    x = np.array(rows, np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    links = near.sum(axis=1) - 1
    assert sum(got[i]["n_links"] for i in ids) >= 0.99 * links.sum()
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, links.tolist()))
    same = 0
    for a, i in enumerate(ids):
        seen = np.zeros(len(ids), bool)
        seen[a] = True
        while (grown := near[seen].any(axis=0)).sum() > seen.sum():
            seen = grown
        same += got[i]["component_id"] == min(ids[k] for k in np.flatnonzero(seen))
    assert same >= 0.99 * len(ids)


@pytest.mark.parametrize("rows, kept_whole", [(12_000, False), (6_000, True)])
def test_embeddings_in_a_crowded_cone(spark, rows, kept_whole):
    """A third of the rows (or all) has a common direction, related but below the threshold, with pairs just above it."""
    rng = np.random.default_rng(11)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    cone, dim, planted = rows if kept_whole else rows // 3, 64, 400
    x = unit(rng.standard_normal((rows, dim)))
    x[:cone] = unit(unit(rng.standard_normal(dim)) * 1.6 + unit(rng.standard_normal((cone, dim))))
    side = rng.standard_normal((planted, dim))
    side = unit(side - (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted])
    x[planted : 2 * planted] = 0.905 * x[:planted] + math.sqrt(1 - 0.905**2) * side
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    y = unit(x.astype(np.float64))
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    assert len(a) >= planted
    joined = sum(got[i]["component_id"] == got[j]["component_id"] for i, j in zip(a.tolist(), b.tolist()))
    assert joined >= 0.98 * len(a)
    assert sum(got[i]["n_links"] for i in range(rows)) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= n for i, n in enumerate(near.sum(axis=1).tolist()))


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.99, 0.01]), (7, None), (8, []), (9, [0.0, 0.0]), (10, [nan, 1.0]), (11, [None, 1.0]), (None, [0.0, 1.0]), (12, [0.0, 2.0]), (13, [inf, 1.0]), (14, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in embeddings.near_duplicates(df).collect())
    alone = {(i, 0, i, True): 1 for i in (7, 8, 9, 10, 11, 13, 14)}
    assert got == Counter({(5, 2, 3, False): 1, (3, 2, 3, True): 2, (None, 1, 12, False): 1, (12, 1, 12, True): 1, **alone})
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    edges += [(0, i) for i in range(2000, 2300)] + [(5, 5), (101, 100)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {x: top(x) for x in above}
