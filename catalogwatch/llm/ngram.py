"""Interpolated modified Kneser-Ney bigrams, counted in Spark, kept as sorted arrays that workers map into memory.

Words are known by a 64-bit hash. The vocabulary is a run of files of sorted hashes with counts; a word's number is its
place in that run. A bigram is one number, context << 32 | word, and the bigrams are a run of files of sorted numbers with
counts. Files cover ranges of numbers that hold a bounded count of training tokens each: contexts that are more frequent
than that are split by their following word, so no task or file grows with the corpus. Of each context the files keep how
many of its bigrams occur once, twice, and more often; of each word, how many contexts it follows.

Tokens travel between the counting and the merging tasks as compressed sorted arrays, aggregated beforehand.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from catalogwatch.llm.store import forget_newest, kept_in_worker, map_array, settle, shared_folder, write_file

# Words of a vocabulary file; training tokens of a bigram file; numbers of a block of words.
WORDS_PER_FILE = 1 << 20
TOKENS_PER_FILE = 3_000_000
BLOCK = 1 << 20
# Tokens that are counted before they are sent on; different words counted before; words a worker remembers.
TOKENS_AT_ONCE = 3_000_000
WORDS_AT_ONCE = 250_000
KEPT_WORDS = 400_000
ROWS = 256
END = b""  # no word is empty
MOST = 255  # counts from here on stand in a list of their own


def text_tokens(text: str | None) -> list[bytes]:
    """Words of a text and one end: A-Z in lower case, split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def word_hash(word: bytes) -> int:
    """XXH64 as a signed number: hashes are ordered as such everywhere here."""
    h = xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


class Segments:
    """A run of files that together are one sorted array; ``firsts`` are their first values."""

    def __init__(self, folder: str, rows: list[dict], kinds: dict[str, str]):
        self.folder, self.rows, self.kinds = folder, rows, kinds
        self.firsts = np.array([r["first"] for r in rows], np.int64)
        self.opened: dict[tuple[int, str], np.ndarray] = {}

    def array(self, k: int, column: str) -> np.ndarray:
        if (k, column) not in self.opened:
            self.opened[k, column] = map_array(f"{self.folder}/{self.rows[k]['name']}.{column}", self.kinds[column])
        return self.opened[k, column]

    def split(self, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(file, a, b): the sorted values a..b of ``wanted`` lie in the range of the file."""
        where = np.searchsorted(self.firsts, wanted, side="right") - 1
        cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(wanted)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a and where[a] >= 0:
                yield int(where[a]), a, b


# --- vocabulary ------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(word_hash, seen), pa.int64()), pa.array(seen.values(), pa.int64())], names=["h", "n"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(text_tokens(text.as_py()))
            if len(seen) > WORDS_AT_ONCE:
                yield out()
                seen.clear()
    yield out()


def _write_vocabulary(folder: str):
    """Files of a partition sorted by hash; gives their names, totals, and the starts of bigram files (see module)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.concatenate(hashes), np.concatenate(counts)
            name = f"vocabulary-{uuid.uuid4().hex}"
            write_file(f"{folder}/{name}.hash", h.astype("<i8").tobytes())
            write_file(f"{folder}/{name}.count", n.astype("<i8").tobytes())
            # A new file begins where the tokens of contexts so far fill one; frequent contexts get several.
            which = np.cumsum(n) // TOKENS_PER_FILE
            starts = np.unique(np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1])) if len(n) else np.zeros(0, np.int64)
            hot = np.flatnonzero(n > TOKENS_PER_FILE)
            shares = [int(-(-x // TOKENS_PER_FILE)) for x in n[hot]]
            return pa.RecordBatch.from_pylist(
                [{"first": int(h[0]), "name": name, "words": len(h), "tokens": int(n.sum()), "starts": starts.tolist(), "hot": hot.tolist(), "shares": shares}],
                pa.schema([("first", pa.int64()), ("name", pa.string()), ("words", pa.int64()), ("tokens", pa.int64()),
                           ("starts", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("shares", pa.list_(pa.int64()))]),
            )

        for batch in batches:
            for at in range(0, batch.num_rows, WORDS_PER_FILE):
                part = batch.slice(at, WORDS_PER_FILE)
                if size + part.num_rows > WORDS_PER_FILE and size:
                    yield flush()
                    hashes, counts, size = [], [], 0
                hashes.append(part.column(0).to_numpy())
                counts.append(part.column(1).to_numpy())
                size += part.num_rows
        if size:
            yield flush()

    return run


class Vocabulary:
    """Numbers and counts of words."""

    def __init__(self, folder: str, rows: list[dict]):
        self.files = Segments(folder, rows, {"hash": "<i8", "count": "<i8"})
        self.offsets = np.cumsum([0, *(r["words"] for r in rows)])
        self.size, self.tokens = int(self.offsets[-1]), sum(r["tokens"] for r in rows)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and training counts."""
        hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
        order = np.argsort(hashes)
        wanted = hashes[order]
        numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        for k, a, b in self.files.split(wanted):
            known = self.files.array(k, "hash")
            place = np.minimum(np.searchsorted(known, wanted[a:b]), len(known) - 1)
            hit = np.flatnonzero(known[place] == wanted[a:b])
            numbers[order[a + hit]] = self.offsets[k] + place[hit]
            counts[order[a + hit]] = self.files.array(k, "count")[place[hit]]
        return numbers, counts


def _cuts(vocabulary: Vocabulary, documents: int) -> np.ndarray:
    """First bigram numbers of the bigram files: contexts' ranges, and frequent contexts split by the following word."""
    width = vocabulary.size + 1
    cuts = []

    def context(u: int, tokens: int) -> None:
        shares = -(-tokens // TOKENS_PER_FILE)
        cuts.extend((u << 32) + width * i // shares for i in range(shares))

    for row, at in zip(vocabulary.files.rows, vocabulary.offsets.tolist()):
        cuts.extend((at + s) << 32 for s in row["starts"])
        for u, shares in zip(row["hot"], row["shares"]):
            context(at + u, shares * TOKENS_PER_FILE)
            cuts.append((at + u + 1) << 32)
    context(vocabulary.size, max(documents, 1))  # the start of a text as a context
    return np.array(sorted(set(cuts)), np.int64)


class _Numbers:
    """Numbers of the words a worker has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        row = list(map(self.known.get, tokens))
        gaps = [i for i, x in enumerate(row) if x is None]
        if gaps:
            new = list({tokens[i] for i in gaps})
            if len(self.known) + len(new) > KEPT_WORDS:
                forget_newest(self.known, KEPT_WORDS)
            fresh = dict(zip(new, self.vocabulary.find(new)[0].tolist()))
            self.known.update(fresh)
            for i in gaps:
                row[i] = fresh[tokens[i]]
        return np.array(row, np.int64)


# --- bigrams ---------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Sorted numbers as differences, others as they are; compressed."""
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _count_bigrams(folder: str, rows: list[dict], cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = kept_in_worker(("ngram-count", folder), lambda: _Numbers(Vocabulary(folder, rows)))
        start = numbers.vocabulary.size
        pairs, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(pairs), return_counts=True)
            where = np.searchsorted(cuts, keys, side="right") - 1
            ends = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(keys)]
            made = []
            for a, b in zip(ends, ends[1:]):
                k, c = keys[a:b], n[a:b]
                gaps = np.diff(k, prepend=0)
                # Planes of bytes: the high ones of sorted numbers are nearly all zero.
                made.append((int(where[a]), b - a, _pack(gaps.view(np.uint8).reshape(-1, 8).T.copy(), c.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy())))
            shard, sizes, data = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["file", "n", "data"])

        for batch in batches:
            for text in batch.column(0):
                row = numbers.of(text_tokens(text.as_py()))
                pairs.append(np.concatenate([[start], row[:-1]]) << 32 | row)
                size += len(row)
                if size >= TOKENS_AT_ONCE:
                    yield out()
                    pairs, size = [], 0
        if size:
            yield out()

    return run


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    gaps = raw[: 8 * n].reshape(8, n).T.copy().view("<i8").ravel()
    return np.cumsum(gaps), raw[8 * n :].reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _write_bigrams(folder: str, cuts: np.ndarray):
    """Merges what has come for a file; gives its name, what the discounts need, and the words' numbers of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = -1

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            many = np.flatnonzero(n >= MOST)
            # Contexts of this file in order, with their bigrams that occur once, twice and more often.
            context = keys >> 32
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            rare = [np.add.reduceat((n == c).astype(np.int64), heads) for c in (1, 2)]
            more = np.add.reduceat((n > 2).astype(np.int64), heads)
            name = f"bigrams-{uuid.uuid4().hex}"
            for column, values in (
                ("key", keys.astype("<i8")), ("count", np.minimum(n, MOST).astype("u1")),
                ("many", np.stack([keys[many], n[many]], 1).astype("<i8")), ("context", context[heads].astype("<i8")),
                ("spread", np.stack([*rare, more], 1).astype("<u4")),
            ):
                write_file(f"{folder}/{name}.{column}", values.tobytes())
            words, contexts = np.unique(keys & 0xFFFFFFFF, return_counts=True)
            blocks = words // BLOCK
            ends = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(words)]
            data = [
                {"block": int(blocks[a]), "n": b - a, "data": _pack(np.diff(words[a:b] % BLOCK, prepend=0).astype("<u4"), contexts[a:b].astype("<u4"))}
                for a, b in zip(ends, ends[1:])
            ]
            one = {"first": int(cuts[current]), "name": name, "size": len(keys), "follows": data}
            one |= {f"n{c}": int((n == c).sum()) for c in (1, 2, 3, 4)}
            return pa.RecordBatch.from_pylist([one], schema)

        follow = pa.struct([("block", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
        schema = pa.schema([("first", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("follows", pa.list_(follow)),
                            *((f"n{c}", pa.int64()) for c in (1, 2, 3, 4))])
        for batch in batches:
            for file, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if file != current and held:
                    yield flush()
                    held = []
                current = file
                held.append(_unpack(data.as_buffer(), n))
        if held:
            yield flush()

    return run


def _write_follows(folder: str, size: int):
    """Dense blocks: of how many contexts each word stands behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, current = None, -1

        def flush() -> pa.RecordBatch:
            name = f"follows-{uuid.uuid4().hex}"
            write_file(f"{folder}/{name}.contexts", total.astype("<i8").tobytes())
            one = {"first": current * BLOCK, "name": name, "sum": int(total.sum())} | {f"n{c}": int((total == c).sum()) for c in (1, 2, 3, 4)}
            one |= {"n": int((total > 0).sum())}
            return pa.RecordBatch.from_pylist([one], schema)

        schema = pa.schema([("first", pa.int64()), ("name", pa.string()), ("sum", pa.int64()), *((f"n{c}", pa.int64()) for c in (1, 2, 3, 4)), ("n", pa.int64())])
        for batch in batches:
            for block, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block != current:
                    if total is not None:
                        yield flush()
                    total, current = np.zeros(min(BLOCK, size - block * BLOCK), np.int64), block
                raw = np.frombuffer(zstandard.decompress(data.as_buffer()), "<u4")
                total[np.cumsum(raw[:n].astype(np.int64))] += raw[n:]
        if total is not None:
            yield flush()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more; the usual thirds where a corpus is too small to tell."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.0), c) for c, d in zip((1.0, 2.0, 3.0), found))])


class Model:
    """A trained model: names of its files (one entry a file) and a few numbers. Arrays are mapped when first used."""

    def __init__(self, folder: str, words: list[dict], bigrams: list[dict], follows: list[dict], documents: int):
        self.folder, self.words, self.documents = folder, words, documents
        self.bigrams, self.follows = bigrams, follows
        self.cut = discounts(*(sum(r[f"n{c}"] for r in bigrams) for c in (1, 2, 3, 4)))
        n = [sum(r[f"n{c}"] for r in follows) for c in (1, 2, 3, 4)]
        self.low_cut = discounts(*n)
        self.low_sum = sum(r["sum"] for r in follows)
        rest = sum(r["n"] for r in follows) - n[0] - n[1]
        self.low_mass = self.low_cut[1] * n[0] + self.low_cut[2] * n[1] + self.low_cut[3] * rest


class Scorer:
    """A model's arrays in one worker."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model.folder, model.words)
        kinds = {"key": "<i8", "count": "u1", "many": "<i8", "context": "<i8", "spread": "<u4"}
        self.bigrams = Segments(model.folder, model.bigrams, kinds)
        self.follows = Segments(model.folder, model.follows, {"contexts": "<i8"})
        self.split_contexts = self._split_contexts()
        self.known: dict[bytes, int] = {}
        self.number, self.base, self.low, self.count = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def _split_contexts(self) -> dict[int, np.ndarray]:
        """Spreads of contexts that are split over several files: their parts are added."""
        owners = [r["first"] >> 32 for r in self.bigrams.rows]
        found = {u: np.zeros(3, np.int64) for u, r in zip(owners, self.bigrams.rows) if r["first"] & 0xFFFFFFFF}
        for k, u in enumerate(owners):
            if u in found:
                own = self.bigrams.array(k, "context")
                found[u] += self.bigrams.array(k, "spread").reshape(-1, 3)[np.searchsorted(own, u)]
        return found

    def lower(self, numbers: np.ndarray) -> np.ndarray:
        """Probabilities by the number of contexts a word follows; unknown words (-1) share one more place."""
        m = self.model
        contexts = np.zeros(len(numbers), np.int64)
        order = np.argsort(numbers, kind="stable")
        wanted = numbers[order]
        for k, a, b in self.follows.split(wanted):
            contexts[order[a:b]] = self.follows.array(k, "contexts")[wanted[a:b] - self.follows.firsts[k]]
        if not m.low_sum:
            return np.full(len(numbers), 1 / (self.vocabulary.size + 1))
        kept = np.maximum(contexts - m.low_cut[np.minimum(contexts, 3)], 0)
        return (kept + m.low_mass / (self.vocabulary.size + 1)) / m.low_sum

    def learn(self, words: list[bytes]) -> None:
        numbers, counts = self.vocabulary.find(words)
        base = np.log10((counts + 0.5) / (self.vocabulary.tokens + 0.5 * (self.vocabulary.size + 1)))
        have = len(self.known)
        self.known.update(zip(words, range(have, have + len(words))))
        self.number, self.base = np.concatenate([self.number[:have], numbers]), np.concatenate([self.base[:have], base])
        self.low, self.count = np.concatenate([self.low[:have], self.lower(numbers)]), np.concatenate([self.count[:have], counts])

    def pairs(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of bigrams, and the spreads of their contexts (once, twice, more often)."""
        keys = before << 32 | after
        order = np.argsort(keys, kind="stable")
        wanted = keys[order]
        counts, spreads = np.zeros(len(keys), np.int64), np.zeros((len(keys), 3), np.int64)
        for k, a, b in self.bigrams.split(wanted):
            part, put = wanted[a:b], order[a:b]
            own = self.bigrams.array(k, "key")
            at = np.minimum(np.searchsorted(own, part), len(own) - 1)
            hit = np.flatnonzero(own[at] == part)
            found = self.bigrams.array(k, "count")[at[hit]].astype(np.int64)
            large = np.flatnonzero(found == MOST)
            if len(large):
                many = self.bigrams.array(k, "many").reshape(-1, 2)
                found[large] = many[np.searchsorted(many[:, 0], part[hit[large]]), 1]
            counts[put[hit]] = found
            contexts = self.bigrams.array(k, "context")
            u = part >> 32
            at = np.minimum(np.searchsorted(contexts, u), len(contexts) - 1)
            hit = np.flatnonzero(contexts[at] == u)
            spreads[put[hit]] = self.bigrams.array(k, "spread").reshape(-1, 3)[at[hit]]
        for u, spread in self.split_contexts.items():
            spreads[before == u] = spread
        return counts, spreads

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        tokens = [text_tokens(t) for t in texts]
        rows = [list(map(self.known.get, x)) for x in tokens]
        new = {t for x, row in zip(tokens, rows) for t, k in zip(x, row) if k is None}
        if new:
            if len(self.known) + len(new) > KEPT_WORDS:
                forget_newest(self.known, KEPT_WORDS)
                new = {t for x in tokens for t in x if t not in self.known}
            self.learn(list(new))
            rows = [[self.known[t] for t in x] for x in tokens]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.concatenate([np.array(x, np.int64) for x in rows])
        starts = np.cumsum(sizes) - sizes
        number, low, count = self.number[at], self.low[at], self.count[at]
        before, totals = np.roll(number, 1), np.roll(count, 1)
        before[starts], totals[starts] = self.vocabulary.size, self.model.documents
        p = low.copy()
        seen = np.flatnonzero((before >= 0) & (totals > 0))
        # An unknown word behind a known context has no bigram, but the context's mass for others counts.
        pair, spread = self.pairs(before[seen], np.where(number[seen] < 0, (1 << 32) - 1, number[seen]))
        cut = self.model.cut
        p[seen] = (np.maximum(pair - cut[np.minimum(pair, 3)], 0) + spread @ cut[1:] * low[seen]) / totals[seen]
        sums = [np.add.reduceat(x, starts) for x in (count > 0, self.base[at], np.log10(p))]
        return list(zip(sizes.tolist(), *(x.tolist() for x in sums)))


def train(texts: DataFrame, text: str = "text") -> Model:
    """The model of all rows of ``texts``, whole. What comes to the driver is one row for each file of the model."""
    spark = texts.sparkSession
    folder = shared_folder(spark, "ngram")
    texts = texts.select(F.col(text).alias("text"))
    words = settle(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-words")
    ordered = words.repartitionByRange(max(1, -(-words.count() // WORDS_PER_FILE)), "h").sortWithinPartitions("h")
    columns = "first long, name string, words long, tokens long, starts array<long>, hot array<long>, shares array<long>"
    rows = [r.asDict() for r in settle(ordered.mapInArrow(_write_vocabulary(folder), columns), "ngram-files").orderBy("first").collect()]
    vocabulary = Vocabulary(folder, rows)
    if vocabulary.size >= 1 << 31:
        raise ValueError("more different words than bigrams are numbered for")
    documents = texts.count()
    cuts = _cuts(vocabulary, documents)
    sent = texts.mapInArrow(_count_bigrams(folder, rows, cuts), "file int, n long, data binary")
    dealt = sent.repartitionById(len(cuts), "file").sortWithinPartitions("file")
    columns = "first long, name string, size long, follows array<struct<block:int,n:long,data:binary>>, n1 long, n2 long, n3 long, n4 long"
    merged = settle(dealt.mapInArrow(_write_bigrams(folder, cuts), columns), "ngram-files")
    bigrams = [r.asDict() for r in merged.drop("follows").orderBy("first").collect()]
    blocks = max(1, -(-vocabulary.size // BLOCK))
    parts = merged.select(F.explode("follows").alias("x")).select("x.block", "x.n", "x.data")
    parts = parts.repartitionById(blocks, "block").sortWithinPartitions("block")
    columns = "first long, name string, sum long, n1 long, n2 long, n3 long, n4 long, n long"
    follows = settle(parts.mapInArrow(_write_follows(folder, vocabulary.size), columns), "ngram-files").orderBy("first").collect()
    return Model(folder, rows, bigrams, [r.asDict() for r in follows], documents)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10): one row per input row.

    A null or empty text is one token, the end. Repeated rows are kept, other columns ignored; an empty table gives an
    empty table, and a model of no texts gives every token one probability. Texts are scored whole.
    """
    total = sum(r["tokens"] for r in model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_in_worker(("ngram", model.folder), lambda: Scorer(model))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, known, base, value = zip(*own.score(part.column(1).to_pylist()))
                columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(n), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, pa.array(base, pa.float64()), pa.array(value, pa.float64())],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    pair = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pair.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
