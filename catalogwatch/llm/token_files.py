"""Token ids in binary files: a shared zstandard dictionary, one frame per document, an offset index for short reads.

A file holds documents in ascending order of id:

    magic, id width, dictionary hash (32 bytes), bucket, part, documents, ids, offset of the index
    frames: the ids of each document, little endian, compressed with the shared dictionary
    index: document ids, a byte for "has an id", numbers of ids, frame ends

Files are numbered by (bucket, part): buckets are ranges of document ids, a bucket of more than ``FILE_BYTES`` goes on
in further parts. The dictionary is trained on whole serialized id arrays of a sample and stands beside the files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import zstandard  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from catalogwatch.llm.store import forget_newest, hash_sample, kept_in_worker, local_path, map_array, settle, shared_folder, write_file  # noqa: E402

MAGIC = b"CWIDS1\n\0"
HEAD = "<8sI32sIIQQQ"
HEAD_BYTES = struct.calcsize(HEAD)
END_ID = 0
FILE_BYTES = 24 << 20
DOCUMENTS_PER_FILE = 8192
# The dictionary: its size, and the number of documents (in expectation) that it is trained on.
DICTIONARY_BYTES = 1 << 16
DICTIONARY_DOCUMENTS = 2000
LEVEL = 3
# Words, and parts of words, that a worker remembers.
KEPT_WORDS = 900_000
KEPT_PARTS = 900_000
ROWS = 256
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")  # a blank that is no cut
# Letters that are letters in every version of Unicode. A word of them and signs, and the same again on a next line: between
# these groups a new token always starts.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f]+"
_PARTS = re.compile(rf"({_LETTERS})([^\w\s']*)(?:(\n)({_LETTERS})([^\w\s']*))?")
_BLANK = "\u0120"  # how a byte-level vocabulary writes a blank
_PLAIN = re.compile(f" {_LETTERS}")


class TokenCoder:
    """Ids of a text as bytes, equal to the tokenizer's own over the whole text.

    A byte-level tokenizer starts a new word at every blank in front of a visible character, whatever stands before, and
    never merges across words. Texts are cut there, and new words once more behind their letters. The library encodes
    each part that isn't known yet; ids of known words and parts are kept.
    """

    def __init__(self, path: str):
        self.library = lib = Tokenizer.from_file(path)
        state = str(lib.pre_tokenizer)
        self.by_word = state.startswith("ByteLevel") and "add_prefix_space=False" in state and "use_regex=True" in state and lib.normalizer is None
        self.width = 2 if lib.get_vocab_size() <= 1 << 16 else 4
        # Tokens that begin with a blank: in a line of words, each in front of a blank, these are the words' first ones.
        self.begins = np.zeros(lib.get_vocab_size(), bool)
        self.begins[[i for token, i in lib.get_vocab().items() if token.startswith(_BLANK)]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, f"<u{self.width}").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts; those that are a blank and letters go through the library many at a time, as one text."""
        plain = [x for x in parts if _PLAIN.fullmatch(x)]
        done: dict[str, bytes] = {}
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            cuts = [*(np.flatnonzero(self.begins[ids]) * self.width).tolist(), len(ids) * self.width]
            ids = ids.tobytes()
            if len(cuts) == len(some) + 1 and not cuts[0]:
                done.update(zip(some, [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
        rest = [x for x in parts if x not in done]
        done.update(zip(rest, self._library(rest)))
        return done

    def _learn(self, words: set[str]) -> None:
        """Adds words (without their blank) to the known ones."""
        known, kept = self.parts, self.words
        # Words of letters alone have nothing to cut.
        whole = [w for w in words if w.isalpha()]
        parts_of_whole = [" " + w for w in whole]
        cut, new = [], set(parts_of_whole)
        match = _PARTS.fullmatch
        for w in words.difference(whole):
            m = match(w)
            parts = (" " + w,) if m is None else (" " + m[1], *[x for x in m.groups()[1:] if x])
            cut.append((w, parts))
            new.update(parts)
        fresh = list(new.difference(known))
        if len(known) + len(fresh) > KEPT_PARTS:
            forget_newest(known, KEPT_PARTS)
            fresh = list(new.difference(known))
        if fresh:
            known.update(self._library_parts(fresh))
        if len(kept) + len(words) > KEPT_WORDS:
            forget_newest(kept, KEPT_WORDS)
        kept.update(zip(whole, map(known.__getitem__, parts_of_whole)))
        for w, parts in cut:
            kept[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])

    def _first(self, word: str) -> bytes:
        """The first word has no blank in front of it."""
        ids = self.parts.get(word)
        if ids is None:
            ids = self._library([word])[0]
            if len(self.parts) < KEPT_PARTS:
                self.parts[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._library([text])[0]
        words = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        out = list(map(self.words.get, words))
        out[0] = self._first(words[0])
        if None in out:
            gaps = [i for i, x in enumerate(out) if x is None]
            self._learn({words[i] for i in gaps})
            for i in gaps:
                out[i] = self.words[words[i]]
        return b"".join(out)


def coder(path: str) -> TokenCoder:
    """One coder for each tokenizer and worker process."""
    return kept_in_worker(("tokens", path), lambda: TokenCoder(path))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, documents: int) -> bytes:
    """A dictionary from about ``documents`` whole documents, trained in one task; empty if they are too few for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        end = end_id.to_bytes(own.width, "little")
        samples = [own.encode(x.as_py()) + end for b in batches for x in b.column(0)]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few or too short
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])

    sample = hash_sample(docs.select("doc_id", "text"), "doc_id", documents)
    # The order is fixed, so that a repeated task trains the same dictionary.
    one = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text")
    made = one.mapInArrow(run, "made binary").first()
    return bytes(made[0]) if made else b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if known:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    documents_per_file: int = DOCUMENTS_PER_FILE, dictionary_documents: int = DICTIONARY_DOCUMENTS,
) -> tuple[str, DataFrame]:
    """Writes ``docs`` into a new shared folder; gives the folder and its manifest ``bucket, part, uri, docs, ids``.

    A null or empty text has only its end id. Rows of one id are all written, ordered by their ids' bytes; a null doc_id
    stands first. An empty table gives no file. Other columns are ignored. The dictionary is trained on a sample of about
    ``dictionary_documents`` rows; everything else covers every row whole.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    pair = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train_dictionary(pair, tokenizer, end_id, dictionary_documents)
    digest = hashlib.sha256(dictionary).digest()
    write_file(f"{folder}/dictionary", dictionary)
    buckets = max(1, -(-pair.count() // documents_per_file))
    # Bounds of the id ranges: one number for each file.
    cuts = pair.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets + 1000)).first()[0]
    bounds = np.array(sorted(set(cuts or ())) if buckets > 1 else [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = coder(tokenizer), _compressor(dictionary)
        end = end_id.to_bytes(own.width, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [own.encode(x.as_py()) + end for x in part.column(1)]
                where = np.searchsorted(bounds, np.array(part.column(0).fill_null(-(2**63))), side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where.astype(np.int32)), part.column(0), pa.array([len(x) // own.width for x in ids], pa.int64()),
                        pa.array([pack.compress(x) for x in ids], pa.binary()),
                    ],
                    names=["bucket", "doc_id", "n", "frame"],
                )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = coder(tokenizer).width
        bucket, part, rows, size = -1, 0, [], 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{bucket:08d}-{part:05d}.ids"
            write_file(uri, pack_file(rows, width, digest, bucket, part))
            values = [bucket, part, uri, len(rows), sum(n for _, n, _ in rows)]
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "part", "uri", "docs", "ids"), values))], manifest)

        manifest = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        for batch in batches:
            for b, i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (b != bucket or size >= FILE_BYTES):
                    yield flush()
                    part, rows, size = (part + 1 if b == bucket else 0), [], 0
                bucket = b
                rows.append((i, n, frame))
                size += len(frame)
        if rows:
            yield flush()

    frames = pair.mapInArrow(encode, "bucket int, doc_id long, n long, frame binary")
    dealt = frames.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "n", "frame")
    return folder, settle(dealt.mapInArrow(store, "bucket int, part int, uri string, docs long, ids long"), "token-manifest")


def pack_file(rows: list[tuple[int | None, int, bytes]], width: int, digest: bytes, bucket: int, part: int) -> bytes:
    frames = b"".join(x[2] for x in rows)
    head = struct.pack(HEAD, MAGIC, width, digest, bucket, part, len(rows), sum(x[1] for x in rows), HEAD_BYTES + len(frames))
    index = [
        np.array([x[0] or 0 for x in rows], "<i8"), np.array([x[0] is not None for x in rows], "u1"),
        np.array([x[1] for x in rows], "<i8"), np.cumsum([len(x[2]) for x in rows]).astype("<i8"),
    ]
    return b"".join([head, frames, *(x.tobytes() for x in index)])


class TokenFile:
    """One file's content (bytes or a mapped array) with its index; frames are decompressed when asked for."""

    def __init__(self, content, dictionary: bytes):
        view = memoryview(content)
        magic, self.width, digest, self.bucket, self.part, n, self.total, at = struct.unpack(HEAD, view[:HEAD_BYTES])
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or written with another dictionary")
        columns = []
        for kind, size in (("<i8", 8), ("u1", 1), ("<i8", 8), ("<i8", 8)):
            columns.append(np.frombuffer(view[at : at + n * size], kind))
            at += n * size
        self.ids, self.known, self.counts, self.ends = columns
        self.view, self.reader = view, _decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> np.ndarray:
        a = HEAD_BYTES + (int(self.ends[k - 1]) if k else 0)
        data = self.reader.decompress(self.view[a : HEAD_BYTES + int(self.ends[k])], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(data, f"<u{self.width}")


def read_document(folder: str, uri: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, by the index of its file: only its own frames are read and decompressed."""
    dictionary = map_array(f"{folder}/dictionary", "u1").tobytes()
    f = TokenFile(map_array(uri, "u1"), dictionary)
    return [f.document(int(k)) for k in np.flatnonzero((f.ids == doc_id) & (f.known == 1))]


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, bucket, part, place``: every document, as its file has it.

    ``start`` is the number of ids of all documents before it: sums over whole files (one manifest row each), then
    within the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = map_array(f"{folder}/dictionary", "u1").tobytes()
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_buffer(), dictionary)
                before = np.cumsum(f.counts) - f.counts
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(len(f))]
                known = pa.array(f.ids, mask=f.known == 0)
                whole = np.full(len(f), f.bucket, np.int32), np.full(len(f), f.part, np.int32), np.arange(len(f), dtype=np.int64)
                columns = [known, pa.array(before), pa.array(f.counts), pa.array(crc, pa.int64()), *map(pa.array, whole)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "within", "n_tokens", "ids_crc32", "bucket", "part", "place"])

    found = "doc_id long, within long, n_tokens long, ids_crc32 long, bucket int, part int, place long"
    if not (local_path(folder) is None or os.path.isdir(local_path(folder))):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").schema("path string, modificationTime timestamp, length long, content binary")
    rows = files.load(folder).select("content").mapInArrow(run, found)
    # One row a file, however many documents there are.
    upto = W.orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = manifest.select("bucket", "part", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("before"))
    return rows.join(starts, ["bucket", "part"]).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "bucket", "part", "place"
    )
