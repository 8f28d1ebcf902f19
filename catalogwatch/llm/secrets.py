"""Secrets in texts: patterns, and character Markov models of random strings and of ordinary identifiers.

Column functions only. Both models are first-order chains over one alphabet, trained from labelled samples; a run of
token characters is a secret if it is much likelier as a random string. Scores are sums of whole thousandths of a bit, so
they don't depend on the order of adding.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.store import hash_sample

# The patterns of the base kinds, in their order.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
# Runs that the models judge; a run starts where none of its characters stands before.
TOKEN = "A-Za-z0-9+/_=-"
RUN = rf"(?<![{TOKEN}])[{TOKEN}]{{20,}}"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
STATES = len(ALPHABET) + 1  # 0: the start
# A run is random if the models differ by so many thousandths of a bit in all and for each character.
LEAST_TOTAL = 25_000
LEAST_EACH = 1_000
# Labelled samples: rows of each kind of random string, and documents (in expectation) whose words are ordinary.
RANDOM_SAMPLES = 1_000
ORDINARY_DOCUMENTS = 1_000

SPAN = "array<struct<start:int,rank:int,end:int>>"


def samples(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``text, random, weight``: hex and base64 forms of digests; numbers, dates, and the words of some documents in usual spellings.

    The number of documents is bounded by ``ORDINARY_DOCUMENTS`` in expectation, the choice is by a hash of the id.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(digest))
    forms = F.array(digest, F.upper(digest), code, F.translate(code, "+/=", ""), F.translate(code, "+/=", "-_"))
    made = spark.range(RANDOM_SAMPLES).select(F.explode(forms).alias("text"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("weight"))
    chosen = hash_sample(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", ORDINARY_DOCUMENTS)
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("weight"))
    number = F.col("weight").cast("string")
    spelled = F.array(
        "w", F.upper("w"), F.concat(F.initcap("w"), F.initcap("w")), F.concat("w", F.lit("_"), "w"), F.concat("w", F.lit("-"), "w"),
        F.concat(F.lit("/"), "w", F.lit("/"), "w", F.lit("=")), F.concat("w", F.lit("-"), number), F.concat("w", number, F.lit("_"), "w"),
    )
    plain = words.select(F.explode(spelled).alias("text"), F.lit(False).alias("random"), "weight")
    # Long numbers, dates and times of day.
    digits = F.conv(F.substring(digest, 1, 15), 16, 10)
    shown = F.array(digits, F.expr("cast(date_add(date'2000-01-01', cast(id * 9 as int)) as string)"), F.regexp_replace(digits, "(..)", "$1-"))
    numbers = spark.range(RANDOM_SAMPLES).select(F.explode(shown).alias("text"), F.lit(False).alias("random"), F.lit(1).cast("long").alias("weight"))
    return made.union(plain).union(numbers)


def train(labelled: DataFrame) -> DataFrame:
    """One row, ``model array<int>``: for each pair of states the log-likelihood ratio in thousandths of a bit.

    Counts are summed over all samples and every pair gets one more, so unseen pairs and empty samples have values.
    """
    before = F.expr(f"transform(split(text, ''), c -> locate(c, '{ALPHABET}'))")
    pairs = labelled.where(f"text RLIKE '^[{TOKEN}]+$'").select("random", "weight", before.alias("s"))
    pairs = pairs.select("random", "weight", F.explode(F.expr("zip_with(concat(array(0), slice(s, 1, size(s) - 1)), s, (a, b) -> a * 1000 + b)")).alias("pair"))
    counts = pairs.groupBy("pair").agg(
        F.sum(F.when(F.col("random"), F.col("weight"))).alias("r"), F.sum(F.when(~F.col("random"), F.col("weight"))).alias("o")
    )
    grid = labelled.sparkSession.range(STATES * STATES).select(
        F.expr(f"cast(id div {STATES} * 1000 + id % {STATES} as int)").alias("pair"), F.col("id").alias("at")
    )
    full = grid.join(counts, "pair", "left").select(
        "at", F.expr("pair div 1000").alias("a"), (F.coalesce("r", F.lit(0)) + 1).alias("r"), (F.coalesce("o", F.lit(0)) + 1).alias("o")
    )
    sums = full.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    ratio = F.log2(F.col("r") / F.col("rs")) - F.log2(F.col("o") / F.col("os"))
    cells = full.join(sums, "a").select("at", F.round(ratio * 1000).cast("int").alias("v"))
    # The alphabet squared: a few thousand cells, whatever the input.
    return cells.agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells")).select(F.col("cells.v").alias("model"))


def _spans(text: Column, pattern: str, rank: int, least: int = 0) -> Column:
    """Spans of all matches: code points, end exclusive. What lies between matches, and the matches, give the places.

    With ``least``, matches go whose group 2 has fewer characters.
    """
    p = F.lit(pattern)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    groups = F.regexp_extract_all(text, p, F.lit(2)) if least else hits
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), groups.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        kept = F.when(F.length(x["g"]) >= least, F.array(span)).otherwise(F.array().cast(SPAN)) if least else F.array(span)
        return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(parts, first, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, base, spans``: one row per input row, other columns ignored.

    ``base`` has the spans of the base patterns and ``spans`` those and the random runs that touch none of them, both as
    ``array<struct<start, rank, end>>`` by start, then kind (``KINDS[rank]``). A null or empty text has no spans; repeated
    rows are kept; an empty table gives an empty table. Texts are scanned whole. ``model`` is the row of :func:`train`.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = train(samples(rows)) if model is None else model
    full = F.coalesce("text", F.lit(""))
    found = rows.select(
        "doc_id", "text",
        F.array_sort(F.concat(_spans(full, ASSIGN, 0, ASSIGN_LENGTH), _spans(full, ACCESS, 1), _spans(full, HEX, 2))).alias("base"),
        _spans(full, RUN, 3).alias("runs"),
    )
    # Runs that no base span touches, with their characters' numbers.
    loose = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    found = found.select("doc_id", "text", "base", loose.alias("runs"), model.scalar().alias("model"))
    score = F.expr(
        "transform(runs, run -> struct(run, transform(split(substring(text, run.start + 1, run.end - run.start), ''), "
        f"c -> locate(c, '{ALPHABET}')) as s))"
    )
    found = found.select("doc_id", "text", "base", "model", score.alias("judged"))
    total = (
        "aggregate(zip_with(concat(array(0), slice(j.s, 1, size(j.s) - 1)), j.s, "
        f"(a, b) -> element_at(model, a * {STATES} + b + 1)), 0L, (x, y) -> x + y)"
    )
    random = F.expr(f"transform(filter(judged, j -> {total} >= greatest({LEAST_TOTAL}, {LEAST_EACH} * size(j.s))), j -> j.run)")
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.rank + 1), ':', s.start, ':', s.end)), ',')")


def redact(found: DataFrame, mark: str = "[secret]") -> Column:
    """Text of a row of :func:`find` with every union of touching or overlapping spans replaced by ``mark``."""
    step = (
        "aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, s) -> named_struct("
        "'at', greatest(acc.at, s.end), 'out', if(s.start >= acc.at and (s.start > acc.at or acc.at = 0), "
        f"concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), '{mark}')), acc.out)), "
        "acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"
    )
    return F.when(F.size("spans") > 0, F.expr(step)).otherwise(F.col("text"))
