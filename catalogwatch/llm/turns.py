"""Repair of conversations: the cheapest edits that make a sequence of turns well formed, found in one pass in order of turn.

Rows are dealt by conversation and sorted by turn; a worker reads them as a stream. Between rows it holds four states of the
output so far (nothing, after a system turn, after a user turn, after an assistant turn), each with its least cost, its
place among the others in the order of edit letters, and the running digest of its output. Which state came from which is one
byte per state and row; a conversation of very many rows writes them to the shared folder, and the letters are read backwards.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.store import map_array, shared_folder, write_file

# Fixed values of the task: kinds of damage by the remainder of the checksum, and the costs of edits.
DAMAGE_OF = 20
DROPPED, EMPTIED, UNMARKED, REPEATED, REROLED = range(5)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = r"\x20\x09-\x0D"
PAIRS = ("su", "ua", "au")
# States of the output, the state after a further user or assistant turn, and what a state still needs at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_NAMES = {"u": "user", "a": "assistant"}
# Rows of a conversation whose back pointers a worker holds at once (four bytes each).
HELD_ROWS = 1 << 20
RESULTS = 2048


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the checksum of ``conv_id:turn``, other columns left out.

    Null roles and texts are one space, and so are null ids and turns in the checksum. Of a dropped row only its conversation
    stays (``present`` is false). A row is repeated as two equal rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % DAMAGE_OF
    marked = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"),
    )
    said = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNMARKED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == REPEATED, 2).otherwise(1))
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == REROLED, "user").otherwise(F.col("role")).alias("role"), said.alias("text"),
        (F.col("kind") != DROPPED).alias("present"), F.explode(times).alias("again"),
    ).drop("again")


def _steps(initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, str, int, str]]:
    """Ways over a row: (state before, state after, edit letters, cost, turn given: k, u, a or none).

    A turn is inserted in front of a row only where the row stays: in front of a deletion it costs the same as behind it, and
    the deletion's letter is the lesser one. More than one can't pay, as two lead back to the state they left.
    """
    ways = [(s, s, "D", DELETE, "") for s in range(4)]
    if must_go:
        return ways
    for letter, given in (("K", initial), ("R", "u"), ("R", "a")):
        for before in range(4):
            for inserted in ("", _NEXT[before]):
                at = _AFTER[inserted][before] if inserted else before
                after = _AFTER.get(given, {}).get(at)
                if after is not None:
                    cost = (REROLE if letter == "R" else 0) + (TRUNCATED if cut else 0) + (INSERT if inserted else 0)
                    ways.append((before, after, ("I" if inserted else "") + letter, cost, "k" if letter == "K" else given))
    return ways


_LETTERS = ("D", "K", "R", "IK", "IR")
_NONE = 255


class Repair:
    """Edits of one conversation, row by row."""

    def __init__(self, folder: str, held: int = HELD_ROWS):
        # state -> (cost, place in the order of letters, digest)
        self.best: dict[int, tuple[int, int, object]] = {START: (0, 0, hashlib.sha256())}
        self.back, self.files, self.folder, self.held = bytearray(), [], folder, held
        self.rows = 0
        self.name = uuid.uuid4().hex

    @staticmethod
    def _write(digest, state: int, text: str):
        after = digest.copy()
        after.update(("" if state == START else "\n").encode() + text.encode("utf-8", "surrogatepass"))
        return after

    def row(self, role: str, text: str, ways: list[tuple[int, int, str, int, str]]) -> None:
        chosen: dict[int, tuple[int, int, str, int, str]] = {}
        for before, after, letters, cost, given in ways:
            if before in self.best:
                total, place, _ = self.best[before]
                way = (total + cost, place, letters, before, given)
                if after not in chosen or way < chosen[after]:
                    chosen[after] = way
        # No prefix is the beginning of another one: all end with the letter of the same row.
        places = {after: k for k, (after, _) in enumerate(sorted(chosen.items(), key=lambda x: x[1][1:3]))}
        made, codes = {}, bytearray([_NONE]) * 4
        for after, (cost, _, letters, before, given) in chosen.items():
            digest, state = self.best[before][2], before
            if letters[0] == "I":
                digest, state = self._write(digest, state, f"{_NAMES[_NEXT[state]]}:"), _AFTER[_NEXT[state]][state]
            if given:
                digest = self._write(digest, state, f"{role if given == 'k' else _NAMES[given]}:{text}")
            made[after] = (cost, places[after], digest)
            codes[after] = before * len(_LETTERS) + _LETTERS.index(letters)
        self.best = made
        self.back += codes
        self.rows += 1
        if len(self.back) >= 4 * self.held:
            self.files.append(f"{self.folder}/{self.name}-{len(self.files)}")
            write_file(self.files[-1], bytes(self.back))
            self.back = bytearray()

    def finish(self) -> tuple[int, str, str]:
        """Cost, edit letters, digest of the repaired rows."""
        state = min(self.best, key=lambda s: (self.best[s][0] + INSERT * len(_ENDS[s]), self.best[s][1]))
        cost, _, digest = self.best[state]
        tail, at = _ENDS[state], state
        for _ in tail:
            digest, at = self._write(digest, at, f"{_NAMES[_NEXT[at]]}:"), _AFTER[_NEXT[at]][at]
        parts = [tail]
        for block in [np.frombuffer(bytes(self.back), np.uint8), *(map_array(x, "u1") for x in reversed(self.files))]:
            own = []
            for k in range(len(block) // 4 - 1, -1, -1):
                state, letters = divmod(int(block[4 * k + state]), len(_LETTERS))
                own.append(_LETTERS[letters])
            parts.append("".join(reversed(own)))
        return cost + INSERT * len(tail), "".join(reversed(parts)), digest.hexdigest()


_ORDER = ("conv", "present", "ord", "role", "text")


def _flagged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows with what their own text says, and the first turn of a role and text that a conversation has at several turns."""
    base = rows.select(
        F.col(conv_id).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )
    white = f"[{WHITE}]"
    own = [F.coalesce("conv", F.lit(" ")), F.col("role"), F.col("text")]
    return base.select(
        "*", F.coalesce("turn", F.lit(-(2**63))).alias("ord"), F.col("turn").isNotNull().alias("numbered"),
        (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{white}*\z")).alias("cut"),
        F.xxhash64(F.lit(1), *own).alias("d1"), F.xxhash64(F.lit(2), *own).alias("d2"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(*_ORDER)


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row for each conversation.

    Rows go by turn, null turns (and -2^63) first, equal turns by role and text; null roles and texts are one space. Rows of
    null conv_id are one conversation. Equal rows of one turn stand side by side, and all but the first are duplicates. Where
    ``present`` is false, a row only names its conversation; a conversation without any other row has zeros, no edits and
    the digest of nothing. An empty table gives an empty table; other columns, whatever their names, are ignored.
    A conversation is read by one task, in memory that doesn't grow with it; what it repeats is found beforehand, from counts.
    """
    spark = rows.sparkSession
    kind = rows.schema[conv_id].dataType
    flagged = _flagged(rows, conv_id, turn, role, text, present)
    firsts = flagged.where("present").groupBy("d1", "d2").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    several = firsts.where("first < last").select("d1", "d2", "first")
    known = flagged.join(several, ["d1", "d2"], "left").withColumn("later", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
    folder = shared_folder(spark, "turn-pointers")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways: dict[tuple, list] = {}
        done: list[tuple] = []
        conv, state = None, None
        for batch in batches:
            values = (batch[c].tolist() for c in ("conv", "present", "ord", "numbered", "role", "text", "blank", "cut", "later"))
            for own, here, at, numbered, said_by, said, blank, cut, later in zip(*values):
                if state is None or own != conv:
                    if state is not None:
                        done.append((conv, *state.result()))
                        if len(done) >= RESULTS:
                            yield pd.DataFrame(done, columns=columns)
                            done = []
                    conv, state = own, _Conversation(folder)
                if here:
                    state.row(at, numbered, said_by, said, blank, cut, later, ways)
        if state is not None:
            done.append((conv, *state.result()))
        if done:
            yield pd.DataFrame(done, columns=columns)

    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ordered = _in_order(known.select("conv", "present", "ord", "numbered", "role", "text", "blank", "cut", "later"))
    return ordered.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(kind))


class _Conversation:
    """Counts of one conversation and its edits so far."""

    def __init__(self, folder: str):
        self.edits = Repair(folder)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.before: tuple | None = None

    def row(self, at: int, numbered: bool, role: str, text: str, blank: bool, cut: bool, later: bool, ways: dict) -> None:
        if numbered:
            if self.most != at:
                self.turns += 1
            self.least, self.most = at if self.least is None else self.least, at
        if self.before is not None and self.before[1][:1] + role[:1] not in PAIRS:
            self.illegal += 1
        again = later or self.before == (at, role, text)
        self.before = (at, role, text)
        again = again and not blank
        cut = cut and not blank and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        key = (role[:1], blank or again, cut)
        if key not in ways:
            ways[key] = _steps(*key)
        self.edits.row(role, text, ways[key])

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        cost, audit, digest = self.edits.finish()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def repaired_rows(
    rows: DataFrame, plans: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """``conv_id, place, turn, role, text``: the rows after the edits of ``plans`` (from :func:`repair` over the same rows).

    Inserted rows have an empty text and no turn. The letters of a conversation travel in front of its rows, so a conversation
    is again one stream.
    """
    kind = rows.schema[conv_id].dataType
    base = _flagged(rows, conv_id, turn, role, text, present).where("present").select(*_ORDER, "numbered")
    heads = plans.select(
        F.col("conv_id").cast("string").alias("conv"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(False).alias("numbered"),
    )
    columns = ["conv_id", "place", "turn", "role", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, letters, at, state, place = None, "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []
            for own, here, number, role, text, numbered in zip(*(batch[c].tolist() for c in (*_ORDER, "numbered"))):
                if not here:
                    conv, letters, at, state, place = own, text, 0, START, 0
                else:
                    step = at
                    while letters[step] == "I":
                        step += 1
                    step += 1
                    for letter in letters[at:step]:
                        if letter != "D":
                            initial = role[:1] if letter == "K" else _NEXT[state]
                            given = {"K": (number if numbered else None, role, text), "R": (number if numbered else None, _NAMES.get(initial), text)}
                            out.append((conv, place, *given.get(letter, (None, _NAMES.get(initial), ""))))
                            state, place = _AFTER[initial][state], place + 1
                    at = step
                # What is left when only insertions follow belongs behind the last row.
                if at < len(letters) and not letters[at:].strip("I"):
                    for _ in letters[at:]:
                        out.append((conv, place, None, _NAMES[_NEXT[state]], ""))
                        state, place = _AFTER[_NEXT[state]][state], place + 1
                    at = len(letters)
            made = pd.DataFrame(out, columns=columns)
            made["turn"] = made["turn"].astype("Int64")
            yield made

    done = _in_order(heads.unionByName(base)).mapInPandas(run, "conv_id string, place long, turn long, role string, text string")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))
