"""A corpus pipeline of five operators: language, near copies, benchmark passages, secrets, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that came before; all but the last give documents
with the columns they came with. Empty tables pass through every stage; repeated rows and nulls are treated as each
function says. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogwatch.llm import decontaminate, langid, pieces, secrets, simhash
from catalogwatch.llm.registry import table
from catalogwatch.llm.store import settle

PIECES = "piece_bpe_32k.model"


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: those without letters, null texts too. The rest is unchanged.

    The model learns from the labelled documents outside fold 0; without any label nothing can be told apart, and only
    documents without letters go.
    """
    model = langid.train_on(docs, public_tokenizers.path(PIECES))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    said = _fresh(docs, "said")
    told = langid.annotate(docs, model, lang=said, score=_fresh(docs, "said_score"))
    return told.where(F.col(said) != langid.NO_LANGUAGE).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once if its row is repeated.

    Rows without an id can't be told apart by it and all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    stay = simhash.near_duplicates(named).where("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(stay, "doc_id", "left_semi").select(*docs.columns)
    nth = _fresh(docs, "nth")
    one = kept.withColumn(nth, F.expr("row_number() over (partition by doc_id order by xxhash64(text), text)")).where(F.col(nth) == 1)
    return one.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with benchmark windows over a twentieth of their words or more.

    The verdict hangs on the text alone and is joined by the text's hash, so ids may be null or repeated.
    """
    keyed = docs.select(F.xxhash64("text", F.lit("text")).alias("key"), "text")
    marked = decontaminate.mark(keyed, table(spark, sf_dir, "benchmark"), doc_id="key")
    key = _fresh(docs, "key")
    dirty = marked.where(decontaminate.contaminated()).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text", F.lit("text"))).join(dirty, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[secret]`` in place of every secret; no document goes. ``n_chars`` follows where a text changed."""
    model = secrets.train(secrets.samples(docs))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = secrets.find(whole, doc_id="row", model=model)
    clean = found.select("doc_id", F.size("spans").alias("n"), secrets.redact(found).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n") > 0, F.length("text").cast("long")).otherwise(F.col("doc_id.n_chars"))}
    return clean.select(*[new.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    done = pieces.encode_decode(docs, public_tokenizers.path(PIECES))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_codec", sentencepiece_codec),
]

# SQL has no forward pass over segmentations, no XXH64 and no piece merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{name}")
    return docs
