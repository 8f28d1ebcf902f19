"""The queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogwatch.llm import centroids, chat, decontaminate, embeddings, extract, langid, ngram, pieces, repeats, secrets, simhash, token_files, turns
from catalogwatch.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ESCAPED = "length({0}) + " + " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROLS)
)
OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {sum(map(len, chat.CONTROLS)) + 1}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.union(extra)))


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _spans_sql(pattern: str, rank: int, keep: str = "TRUE", group: int = 0) -> str:
    """Spans of a pattern's matches from what lies between them; ``keep`` is a condition on ``gs[i]``, the match's group."""
    q = pattern.replace("'", "''")
    at = "CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INTEGER)"
    return f"""SELECT doc_id, t, {at} AS start, {rank} AS rank, {at} + CAST(length(hits[i]) AS INTEGER) AS stop, gs[i] AS g FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, t, string_split_regex(t, '{q}') AS gaps,
        regexp_extract_all(t, '{q}', 0) AS hits, regexp_extract_all(t, '{q}', {group}) AS gs FROM d)) WHERE {keep}"""


_STATES_SQL = f"list_transform(string_split({{0}}, ''), lambda c: instr('{secrets.ALPHABET}', c))"
_PAIRS_SQL = "list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE s[i - 1] END * 1000 + s[i])"
# Equal as long as the documents aren't more than the bound of the labelled samples: then all of them are samples.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rnd AS (SELECT id, sha256(CAST(id AS VARCHAR)) AS x, base64(unhex(sha256(CAST(id AS VARCHAR)))) AS c, CAST(CAST('0x' || substring(sha256(CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS VARCHAR) AS n
  FROM range({secrets.RANDOM_SAMPLES}) r(id)),
w AS (SELECT w, count(*) AS k, upper(w[1]) || lower(w[2:]) AS i, CAST(count(*) AS VARCHAR) AS n FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z]+')) AS w FROM d) GROUP BY w),
labelled AS (
  SELECT unnest([x, upper(x), c, translate(c, '+/=', ''), replace(translate(c, '+/', '-_'), '=', '')]) AS text, TRUE AS random, 1 AS k FROM rnd
  UNION ALL SELECT unnest([w, upper(w), i || i, w || '_' || w, w || '-' || w, '/' || w || '/' || w || '=', w || '-' || n, w || n || '_' || w]), FALSE, k FROM w
  UNION ALL SELECT unnest([n, CAST(CAST(DATE '2000-01-01' + CAST(id * 9 AS INTEGER) AS DATE) AS VARCHAR), regexp_replace(n, '(..)', '\\1-', 'g')]), FALSE, 1 FROM rnd),
st AS (SELECT random, k, {_STATES_SQL.format("text")} AS s FROM labelled WHERE regexp_full_match(text, '[{secrets.TOKEN}]+')),
pc AS (SELECT pair, sum(k) FILTER (WHERE random) AS r, sum(k) FILTER (WHERE NOT random) AS o FROM (SELECT random, k, unnest({_PAIRS_SQL}) AS pair FROM st) GROUP BY pair),
grid AS (SELECT a * 1000 + b AS pair, a, coalesce(r, 0) + 1 AS r, coalesce(o, 0) + 1 AS o FROM range({secrets.STATES}) x(a), range({secrets.STATES}) y(b) LEFT JOIN pc ON pair = a * 1000 + b),
cell AS (SELECT pair, CAST(round((log2(r / sum(r) OVER (PARTITION BY a)) - log2(o / sum(o) OVER (PARTITION BY a))) * 1000) AS BIGINT) AS v FROM grid),
base AS ({_spans_sql(secrets.ASSIGN, 0, f"length(gs[i]) >= {secrets.ASSIGN_LENGTH}", 2)}
  UNION ALL {_spans_sql(secrets.ACCESS, 1)} UNION ALL {_spans_sql(secrets.HEX, 2)}),
run AS ({_spans_sql(f"[{secrets.TOKEN}]{{20,}}", 3)}),
loose AS (SELECT * FROM run WHERE NOT EXISTS (FROM base WHERE base.doc_id = run.doc_id AND base.start < run.stop AND run.start < base.stop)),
judged AS (SELECT doc_id, start, any_value(stop) AS stop, sum(v) AS total FROM (SELECT doc_id, start, stop, unnest({_PAIRS_SQL}) AS pair
  FROM (SELECT *, {_STATES_SQL.format("g")} AS s FROM loose)) JOIN cell USING (pair) GROUP BY doc_id, start),
spans AS (SELECT doc_id, start, rank, stop FROM base UNION ALL SELECT doc_id, start, 3, stop FROM judged WHERE total >= greatest({secrets.LEAST_TOTAL}, {secrets.LEAST_EACH} * (stop - start))),
said AS (SELECT doc_id, rank, start, {list(secrets.KINDS)}[rank + 1] || ':' || start || ':' || stop AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id
"""


@query("op3_secret_scan", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(base, s -> s.rank = {k})) as long)").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *n, F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans")
    )


@query("op4_embedding_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_on(docs, public_tokenizer("piece_bpe_32k.model"))
    # The fold is a function of the id that the row carries, so the table isn't joined to its predictions.
    held_out = F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


@query("op6_ngram_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(ngram.fold() != 1))
    held_out = F.coalesce(ngram.fold() == 1, F.lit(False)).alias("held_out")
    scored = ngram.score(docs, model)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _words_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS m FROM (SELECT item_id, {_words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win FROM b),
dw AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: {{'i': i, 'win': array_to_string(w[i:i + m - 1], ' ')}})) AS x
  FROM d JOIN (SELECT DISTINCT m FROM bw) s ON len(w) >= m),
hit AS (SELECT DISTINCT doc_id, dw.m, x.i AS i, item_id FROM dw JOIN bw ON dw.m = bw.m AND x.win = bw.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND coalesce(n, 0) * 20 >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query("op8_sentencepiece_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def _nearest_sql(k: int) -> str:
    """Every vector with its nearest centroid of round ``k``; number and distance are packed, so that ties go to the smaller number."""
    return f"""a{k} AS MATERIALIZED (SELECT e.row, any_value(e.v) AS v, CAST(min(list_sum(list_transform(range(1, {centroids.DIMENSIONS + 1}), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i]))) * {centroids.CENTROIDS} + c.k) AS BIGINT) AS best
  FROM e, c{k} c GROUP BY e.row)"""


def _moved_sql(k: int) -> str:
    """The centroids after round ``k``: exact floors of the means, the old one where a cluster is empty."""
    return f"""c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT best % {centroids.CENTROIDS} AS k, i, sum(x) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range(1, {centroids.DIMENSIONS + 1})) AS i FROM a{k}) GROUP BY 1, 2)
  GROUP BY k) m USING (k))"""


OP11_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SALT}' || vec_id) NULLS LAST, v) - 1 AS k, v FROM e QUALIFY k < {centroids.CENTROIDS}),
{", ".join(f"{_nearest_sql(k)}, {_moved_sql(k)}" for k in range(centroids.ROUNDS))},
{_nearest_sql(centroids.ROUNDS)},
r AS (SELECT vec_id, best % {centroids.CENTROIDS} AS k, best // {centroids.CENTROIDS} AS distance FROM a{centroids.ROUNDS} JOIN e USING (row))
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM r JOIN c{centroids.ROUNDS} c USING (k)
"""


@query("op11_centroid_clusters", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


@query("op12_suffix_array_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


_FAR = 10**9


def _edit(state: str, cost: str, letter: str, out: str | None = None) -> str:
    said = f"{state}.o" if out is None else f"coalesce({state}.o || chr(10), '') || {out}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {said}}}"


def _least(*ways: str) -> str:
    """Least cost, then least letters."""
    return f"list_sort([{', '.join(ways)}])[1]"


def _stays(state: str, initial: str, name: str | None) -> list[str]:
    """Keep, and reroling where that can give ``initial``."""
    own = f"CASE WHEN left(role, 1) = '{initial}' AND NOT gone THEN 0 ELSE {_FAR} END + cut"
    ways = [_edit(state, own, "K", "role || ':' || text")]
    if name:
        ways.append(_edit(state, f"CASE WHEN gone THEN {_FAR} ELSE {turns.REROLE} END + cut", "R", f"'{name}:' || text"))
    return ways


_CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP13_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {_CRC_SQL} % {turns.DAMAGE_OF} AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = {turns.REROLED} THEN 'user' ELSE role END AS role,
    CASE WHEN kind = {turns.EMPTIED} THEN '' WHEN kind = {turns.UNMARKED} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = {turns.REPEATED} THEN 2 ELSE 1 END)) AS again FROM kinds WHERE kind <> {turns.DROPPED}),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM damaged),
seen AS (SELECT *, NOT regexp_matches(text, '[^{turns.WHITE}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again_said,
    NOT regexp_matches(text, '[.!?][{turns.WHITE}]*\\z') AS unfinished, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
marked AS MATERIALIZED (SELECT *, blank OR again_said AS gone, CASE WHEN unfinished THEN {turns.TRUNCATED} ELSE 0 END AS cut FROM seen),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND again_said) AS duplicate, count(*) FILTER (WHERE NOT gone AND unfinished) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('{"', '".join(turns.PAIRS)}')) AS illegal FROM marked GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST(NULL AS VARCHAR)}} AS s0, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': CAST(NULL AS VARCHAR)}} AS s1,
    {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': CAST(NULL AS VARCHAR)}} AS s2, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': CAST(NULL AS VARCHAR)}} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, {_edit("s0", str(turns.DELETE), "D")}, {_least(_edit("s1", str(turns.DELETE), "D"), *_stays("s0", "s", None))},
    {_least(_edit("s2", str(turns.DELETE), "D"), *_stays("s0", "u", "user"), *_stays("s1", "u", "user"), *_stays("x3", "u", "user"))},
    {_least(_edit("s3", str(turns.DELETE), "D"), *_stays("x2", "a", "assistant"))}
  FROM (SELECT m.*, s0, s1, s2, s3, {_least("s2", *(_edit(s, str(turns.INSERT), "I", "'user:'") for s in ("s0", "s1", "s3")))} AS x2,
      {_least("s3", _edit("s2", str(turns.INSERT), "I", "'assistant:'"))} AS x3
    FROM dp JOIN marked m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1)),
ends AS (SELECT dp.conv_id, {_least("s0", "s3", _edit("s2", str(turns.INSERT), "I", "'assistant:'"), f"{{'c': s1.c + {2 * turns.INSERT}, 'a': s1.a || 'II', 'o': s1.o || chr(10) || 'user:' || chr(10) || 'assistant:'}}")} AS e
  FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")), present="present")
