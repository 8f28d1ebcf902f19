"""SentencePiece BPE by a prefix table: linear in the text, equal to the library's own merging.

A merge-type encoding of any prefix of a text ends in exactly one token, and that token is the one match ending there
which is compatible with the last token of the prefix in front of it. Two tokens are compatible if merging their joined
string gives just these two. So one pass over the automaton's matches stores the last token of every prefix, and the ids
are read off backwards.

No piece holds a blank behind another character, so merges never cross from a word to the blank of the next one. Texts
are cut there, and each worker keeps the ids of words it has met (a bounded store).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.store import forget_newest, kept_in_worker

BLANK = "▁"
# Words a worker remembers, and token pairs whose test it remembers; beyond either it forgets the newer half.
KEPT_WORDS = 400_000
KEPT_PAIRS = 500_000
# Rows of an output batch.
ROWS = 256
_WORDS = re.compile(" +[^ ]*")


class PieceCoder:
    """Encodes like the library with the model at ``path``, without begin or end ids; decodes with the library."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)
        self.ids = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not special(i)}
        self.scores = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        self.names = {i: piece for piece, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("a piece of this model spans words")
        self.kind = "<u2" if lib.get_piece_size() <= 1 << 16 else "<u4"
        self.automaton = ahocorasick.Automaton()
        # Of each token: when its last merge happens (-1: a character), and the tokens that it joins.
        self.when: dict[int, float] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            steps: list[tuple[str, str]] = []
            # Runs of blanks share one score, so the order of their merges isn't the pieces' own: see encode_word.
            if not piece.startswith(BLANK * 2) and self.merge(piece, steps) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
                self.when[i] = -self.scores[piece] if steps else -1
                if steps:
                    self.halves[i] = (self.ids[steps[-1][0]], self.ids[steps[-1][1]])
        self.automaton.make_automaton()
        # Characters that stand side by side in some piece; between any others no merge ever happens.
        self.beside = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """The library's rule: join the best-scored neighbours, the leftmost of equals, until none can be joined."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != both:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j], right[i] = both, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in parts if x is not None]

    def _fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                forget_newest(self.pairs, KEPT_PAIRS)
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined string of two tokens gives just these two.

        Goes back in time along the border: the tokens beside it are taken apart, the later-made one first. They stood
        side by side until then, so if they could have been joined sooner, a merge across the border came first.
        """
        names, when, scores = self.names, self.when, self.scores
        until = float("inf")
        while True:
            score = scores.get(names[a] + names[b])
            if score is not None and -score < until:
                return False
            if when[a] > when[b]:
                until, a = when[a], self.halves[a][1]
            elif when[b] >= 0:
                # Of two equal merges the left one comes first, so one across the border would have won.
                until, b = when[b] + 0.5, self.halves[b][0]
            else:
                return True

    def _spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word with its blank in front, or of any text whose blanks all stand at its start."""
        if word.startswith(BLANK * 2):
            return [i for p in self.merge(word) for i in ((self.ids[p],) if p in self.ids else self._spelled(p))]
        # The last token of each prefix; -1 where that is a character without a piece, which joins with nothing.
        last = [-1] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = last[end + 1 - size]
                if before < 0 or (pairs[before, token] if (before, token) in pairs else self._fits(before, token)):
                    last[end + 1] = token
        ids: list[int] = []
        at = len(word)
        while at:
            if last[at] < 0:
                ids += reversed(self._spelled(word[at - 1]))
                at -= 1
            else:
                ids.append(last[at])
                at -= len(self.names[last[at]])
        ids.reverse()
        return ids

    def _packed(self, word: str) -> bytes:
        """Ids of a word as bytes, put together from the parts between which no merge can happen."""
        beside, known = self.beside, self.parts
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in beside]
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(word)]):
            part = word[a:b]
            ids = known.get(part)
            if ids is None:
                if len(known) >= KEPT_WORDS:
                    forget_newest(known, KEPT_WORDS)
                ids = known[part] = np.array(self.encode_word(part), self.kind).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        text = text.replace(BLANK, " ")
        words = text.split(" ")
        kept = self.words
        for again in (False, True):
            out = list(map(kept.get, words))
            gaps = [i for i, x in enumerate(out) if x is None]
            new = {words[i] for i in gaps}
            if again or "" not in new:  # never kept: a sign of blanks in a row or at an end
                break
            words = [x[1:] for x in _WORDS.findall(" " + text)]
        if len(kept) + len(new) > KEPT_WORDS:
            forget_newest(kept, KEPT_WORDS)
        for w in new:
            kept[w] = self._packed(BLANK + w.replace(" ", BLANK))
        for i in gaps:
            out[i] = kept[words[i]]
        kept.pop("", None)
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def coder(path: str) -> PieceCoder:
    """One coder for each model and worker process."""
    return kept_in_worker(("pieces", path), lambda: PieceCoder(path))


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` and, with ``decode``, ``decoded``: one row per input row, other columns ignored.

    ``model`` is a path that every executor has. A null or empty text has no ids and decodes to the empty text. Repeated
    rows and ids are kept as they are; an empty table gives an empty table. A text of any length is encoded whole.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))] + [pa.field("decoded", pa.string())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [own.encode(x.as_py()) for x in part.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32, copy=False))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    pair = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pair.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)
