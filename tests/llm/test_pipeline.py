import hashlib
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from catalogwatch.llm import secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id int, row string"
LONG = "the quick brown fox jumps over the lazy dog while seven clever cats watch it from an old wall and say nothing at all"
BENCH = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    item = spark.read.parquet(f"{BENCH}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (None, None), (1, ""), (2, "123 456"), (3, LONG), (4, LONG), (4, LONG), (5, LONG.upper()), (6, "token = 'abcdefgh1234' stays here"),
        (7, item), (None, item), (8, f"{LONG} and now something else entirely about ships and the sea"), (None, LONG),
    ]
    docs = spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or ""), 1, "r") for i, t in rows], SCHEMA)
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        made = stage(spark, docs, BENCH)
        assert made.columns == docs.columns
        docs = pipeline.settle(made, f"test-{k}")
    left = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    assert set(left) == {(3, LONG), (6, "[secret]' stays here"), (8, rows[10][1]), (None, LONG)}
    assert left[6, "[secret]' stays here"]["n_chars"] == len("[secret]' stays here")
    assert pipeline.STAGES[-1][1](spark, docs, BENCH).count() == 4
    docs = docs.limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, BENCH)
    assert docs.count() == 0


def test_columns_of_any_name_are_carried(spark):
    names = ["_key", "key", "_nth", "NTH", "_said", "said", "said_", "_share", "said_score", "row", "fp", "spans"]
    rows = [(1, LONG, "en", len(LONG)), (2, LONG, "en", len(LONG)), (3, "Der Hund schläft. token = 'abcdefgh1234'", None, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, BENCH)
        assert made.columns == docs.columns
        docs = pipeline.settle(made, "test-names")
    assert {r["doc_id"]: [r[n] for n in names] for r in docs.collect()} == {i: [f"{n}{i}" for n in names] for i in (1, 3)}


def test_run_equals_brute_force(spark):
    """Each stage by plain means: letters, all pairs of fingerprints, all windows, spans cut by hand, the tokenizer's library."""
    rows = spark.read.parquet(f"{BENCH}/documents.parquet").collect()
    kept = [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    prints = [simhash.fingerprint(r["text"]) for r in kept]
    parent = list(range(len(kept)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(kept):
        least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    kept = [r for k, r in enumerate(kept) if least[root(k)] == r["doc_id"]]

    split = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [split(r["text"]) for r in spark.read.parquet(f"{BENCH}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12)) if w}

    def dirty(text):
        words, hit = split(text), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(words)

    kept = [r for r in kept if not dirty(r["text"])]
    docs = spark.createDataFrame(kept, spark.read.parquet(f"{BENCH}/documents.parquet").schema)
    spans = {r["doc_id"]: r["spans"] for r in secrets.find(docs, model=secrets.train(secrets.samples(docs))).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECES))
    want = {}
    for r in kept:
        text, runs = list(r["text"]), []
        for s in sorted(spans[r["doc_id"]], key=lambda s: s["start"]):
            if runs and s["start"] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s["end"])
            else:
                runs.append([s["start"], s["end"]])
        for a, b in reversed(runs):
            text[a:b] = ["[secret]"]
        ids = lib.encode("".join(text))
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, BENCH).collect()}
    assert got == want and len(want) > 100
