"""Language of a text by unigram pieces whose segmentation is summed out.

Each language has probabilities of the pieces of one public vocabulary. The probability of a word is the sum over all its
segmentations into pieces, computed by a forward pass; no piece reaches over a word, so a text's log-probability is the
sum over its words. The piece probabilities are trained by expectation steps (forward and backward) over the words of
labelled documents, and every step is a Spark job over word counts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.llm.store import forget_newest, kept_in_worker, settle

BLANK = "▁"
NO_LANGUAGE = "und"
# Training: documents of each language (in expectation), expectation steps, weight of unseen pieces.
DOCUMENTS_PER_LANGUAGE = 1000
STEPS = 2
UNSEEN = 0.01
# Words a worker remembers; words that are passed forward at once; longer words are passed on their own.
KEPT_WORDS = 350_000
CHUNK = 8192
LONG = 48
# A word's sum below this is computed again in a way that can't underflow.
FAINT = 1e-200
ROWS = 256
_WORDS = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    words = _WORDS.findall((text or "").lower())
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


class Lattice:
    """All pieces of a vocabulary that start at each character of some words."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = [lib.id_to_piece(i) for i in plain]
        self.longest = max(map(len, self.pieces))
        # The last two numbers: a character without a piece; no piece here.
        self.unknown, self.none = len(self.pieces), len(self.pieces) + 1
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for k, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                node = edges.setdefault(node << 21 | ord(c), len(edges) + 1)
            ends[node] = k
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(edges) + 1, self.none, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces by (character, length - 1), the first character of each word, and the words' lengths with the blank."""
        codes = np.frombuffer("".join([BLANK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        found = np.full((len(codes), self.longest), self.none, np.int32)
        at, node, stop = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.repeat(ends, sizes)
        for length in range(self.longest):
            inside = at + length < stop[at]
            at, node = at[inside], node[inside]
            wanted = node << 21 | codes[at + length]
            where = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[where] == wanted
            at, node = at[there], self.child[where[there]]
            found[at, length] = self.piece[node]
        found[found[:, 0] == self.none, 0] = self.unknown
        return found, ends - sizes, sizes


def lattice(path: str) -> Lattice:
    return kept_in_worker(("lattice", path), lambda: Lattice(path), "language")


def _forward(found: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Summed probabilities of all segmentations of every beginning of every word, by (word, length, language).

    Words come longest first, so those that still go on at a length are the first ones.
    """
    out = np.zeros((len(sizes), int(sizes[0]) + 1, p.shape[1]))
    out[:, 0] = 1
    for t in range(1, int(sizes[0]) + 1):
        n = int(np.searchsorted(-sizes, -t, side="right"))
        for length in range(1, min(t, found.shape[1]) + 1):
            out[:n, t] += out[:n, t - length] * p[found[starts[:n] + t - length, length - 1]]
    return out


def _long_word(found: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probability of one word of any length: only the last beginnings are kept, scaled."""
    last: deque[np.ndarray] = deque([np.ones(p.shape[1])], maxlen=found.shape[1])
    scale = np.zeros(p.shape[1])
    for t in range(1, len(found) + 1):
        n = len(last)
        now = sum(last[n - k] * p[found[t - k, k - 1]] for k in range(1, n + 1))
        last.append(now)
        small = now < 1e-100
        if small.any():
            by = np.where(small, now, 1.0)
            last = deque([x / by for x in last], maxlen=last.maxlen)
            scale += np.log(by)
    return np.log(last[-1]) + scale


def word_scores(grid: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Natural log-probabilities by (word, language)."""
    out = np.zeros((len(words), p.shape[1]))
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    few = 0
    while few < len(order) and len(words[order[few]]) > LONG:
        out[order[few]] = _long_word(grid.matches([words[order[few]]])[0], p)
        few += 1
    for at in range(few, len(order), CHUNK):
        part = order[at : at + CHUNK]
        found, starts, sizes = grid.matches([words[k] for k in part])
        sums = _forward(found, starts, sizes, p)[np.arange(len(part)), sizes]
        faint = np.flatnonzero((sums < FAINT).any(axis=1))
        sums[faint] = 1
        out[part] = np.log(sums)
        for k in faint.tolist():
            out[part[k]] = _long_word(found[starts[k] : starts[k] + sizes[k]], p)
    return out


def _faint_counts(found: np.ndarray, weight: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected pieces of one word, in logarithms."""
    n = len(found)
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    steps = [(t, t + length + 1, piece) for t in range(n) for length, piece in enumerate(found[t].tolist()) if piece < len(p) - 1]
    forward, backward = (np.full((n + 1, p.shape[1]), -np.inf) for _ in "ab")
    forward[0] = backward[n] = 0
    for a, b, piece in steps:
        forward[b] = np.logaddexp(forward[b], forward[a] + logs[piece])
    for a, b, piece in reversed(steps):
        backward[a] = np.logaddexp(backward[a], backward[b] + logs[piece])
    for a, b, piece in steps:
        total[piece] += weight * np.exp(forward[a] + logs[piece] + backward[b] - forward[n])


def expected_counts(grid: Lattice, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected numbers of each piece by (piece, language) in words that occur ``weights[word, language]`` times."""
    total = np.zeros(p.shape)
    order = sorted((k for k in range(len(words)) if len(words[k]) <= LONG), key=lambda k: -len(words[k]))
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        found, starts, sizes = grid.matches([words[k] for k in part])
        alpha = _forward(found, starts, sizes, p)
        rows = np.arange(len(part))
        # Of these words the plain sums say nothing, and of the others what underflows is too little to count.
        faint = np.flatnonzero((alpha[rows, sizes] < FAINT).any(axis=1))
        for k in faint.tolist():
            _faint_counts(found[starts[k] : starts[k] + sizes[k]], weights[part[k]], p, total)
        alpha[faint, sizes[faint]] = 1
        share = weights[part] / alpha[rows, sizes]
        share[faint] = 0
        beta = np.zeros_like(alpha)
        beta[rows, sizes] = 1
        for t in range(int(sizes[0]), 0, -1):
            n = int(np.searchsorted(-sizes, -t, side="right"))
            for length in range(1, min(t, found.shape[1]) + 1):
                piece = found[starts[:n] + t - length, length - 1]
                used = np.flatnonzero(piece != grid.none)
                through = p[piece[used]] * beta[used, t]
                beta[used, t - length] += through
                np.add.at(total, piece[used], alpha[used, t - length] * through * share[used])
    return total


class Model:
    """Languages, and piece probabilities by (piece, language); the last row (no piece) is zero."""

    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.vocabulary, self.languages, self.p = vocabulary, languages, p
        self.key = hashlib.sha256(p.tobytes() + repr((vocabulary, languages)).encode()).hexdigest()


def _probabilities(counts: np.ndarray) -> np.ndarray:
    p = (counts[:-1] + UNSEEN) / (counts[:-1].sum(axis=0) + UNSEEN * (len(counts) - 1))
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def train(labelled: DataFrame, vocabulary: str, per_language: int = DOCUMENTS_PER_LANGUAGE, steps: int = STEPS) -> Model:
    """A model from ``labelled(key, text, lang)``; rows of null language or text are left out.

    Words of more than ``LONG`` letters don't take part. The sample is bounded: about ``per_language`` documents of each language, chosen by a hash of the key. Only numbers of
    documents by language and the model itself (pieces times languages) come to the driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model(vocabulary, [], np.zeros((0, 0)))
    cuts = [[F.lit(k), F.lit(min(2**63 - 1, int(2**63 * (2 * per_language / n - 1))))] for k, n in counts.items()]
    cut = F.create_map(*[x for pair in cuts for x in pair])[F.col("lang")]
    chosen = rows.where(F.xxhash64("key", F.lit("language")) <= cut).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.update((lang, w) for w in text_words(text.as_py()) if len(w) <= LONG)
            langs, words = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"]
            )

    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = settle(words, "language-words")
    size = lattice(vocabulary).none + 1
    k = len(languages)
    # The first step starts from equal probabilities, for which only a piece's length counts.
    p = np.full((size, k), 1e-3)
    p[-1] = 0
    for _ in range(steps):

        def expect(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            grid = lattice(vocabulary)
            number = {x: i for i, x in enumerate(languages)}
            total = np.zeros(p.shape)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                weights = np.zeros((len(texts), p.shape[1]))
                weights[np.arange(len(texts)), [number[x] for x in batch.column(0).to_pylist()]] = batch.column(2).to_numpy()
                total += expected_counts(grid, texts, weights, p)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        # Sums over tasks are added in a fixed order here, so that the model doesn't hang on the order of arrival.
        parts = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.array_sort(F.collect_list("n")).alias("n"))
        table = parts.toArrow()
        counts_now = np.zeros((size, k))
        sums = [sum(x) for x in table.column("n").to_pylist()]
        counts_now[table.column("piece").to_numpy(), table.column("lang").to_numpy()] = sums
        p = _probabilities(counts_now)
    return Model(vocabulary, languages, p)


class _Scorer:
    """Scores of the words a worker has met."""

    def __init__(self, model: Model):
        self.model, self.number, self.scores = model, {}, np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        fresh, have = list(words), len(self.number)
        self.number.update(zip(fresh, range(have, have + len(fresh))))
        if have + len(fresh) > len(self.scores):
            grown = np.zeros((max(have + len(fresh), 2 * len(self.scores)), self.scores.shape[1]))
            grown[:have] = self.scores[:have]
            self.scores = grown
        self.scores[have : have + len(fresh)] = word_scores(lattice(self.model.vocabulary), fresh, self.model.p)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(NO_LANGUAGE, 0.0)] * len(texts)
        split = [text_words(t) for t in texts]
        rows = [list(map(self.number.get, words)) for words in split]
        new = {w for words, row in zip(split, rows) for w, x in zip(words, row) if x is None}
        if new:
            if len(self.number) + len(new) > KEPT_WORDS:
                forget_newest(self.number, KEPT_WORDS)
                new = {w for words in split for w in words if w not in self.number}
                if len(self.number) + len(new) > KEPT_WORDS and len(texts) > 1:
                    return [x for t in texts for x in self.predict([t])]
            self.learn(new)
            rows = [[self.number[w] for w in words] for words in split]
        return [self._verdict(np.array(row, np.int64)) for row in rows]

    def _verdict(self, row: np.ndarray) -> tuple[str, float]:
        if not len(row):
            return NO_LANGUAGE, 0.0
        total = self.scores[row].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def annotate(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, named by the caller: the language and its score. See :func:`identify`."""
    if {lang, score} & set(docs.columns):
        raise ValueError("a column of the predictions is there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_in_worker(("language", model.key), lambda: _Scorer(model))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                said = own.predict(part.column(text).to_pylist())
                more = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: one row per input row; only the text is looked at, other columns are ignored.

    A null text, one without letters, or any text under a model without languages is ``und`` with a score of 0; else the
    score is the likeliest language's share (all languages being as likely beforehand), equal ones go to the first in
    order. Texts of any length are scored whole; repeated rows are kept; an empty table gives an empty table.
    """
    pair = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return annotate(pair, model).select("doc_id", "lang_pred", "score")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train_on(docs: DataFrame, vocabulary: str) -> Model:
    """The model of the documents outside fold 0."""
    return train(docs.where(fold() != 0).select(F.col("doc_id").alias("key"), "text", "lang"), vocabulary)
