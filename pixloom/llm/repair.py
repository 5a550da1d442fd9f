"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the grammar, by layers of cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored

# States of the grammar (s?(ua)+)?: at the start, after s, after u, after a. Where each role leads; -1: nowhere.
STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: Where a role of one's choice leads: user, or assistant after a user.
CHOICE = (2, 2, 3, 2)
#: Costs of keeping, reroling, inserting and deleting a turn, and of leaving a truncated one.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: Cost of ending in each state, in insertions.
END = (0, 2 * INSERT, INSERT, 0)
ROLES = "sua"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Turns of a segment, whose layers are made at once; turns and characters of a chunk, a row of the shared table.
SEGMENT, CHUNK_TURNS, CHUNK_CHARS = 12, 4096, 1 << 20
_PAD, _FAR = 255, 1 << 30
SPACE = " \t\n\x0b\x0c\r"


def _before(step: tuple[int, ...]) -> np.ndarray:
    """Of each set of states (as bits) the set of those that ``step`` leads into it."""
    return np.array([sum(1 << q for q, to in enumerate(step) if to >= 0 and to_set >> to & 1) for to_set in range(16)], np.uint8)


_KEPT = np.stack([*(_before(STEP[r]) for r in ROLES), np.zeros(16, np.uint8)])
_CHOSEN = _before(CHOICE)


def layers(codes: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """[cost, turn, segment]: the set of states, as four bits, from which what is left of a segment can be had at exactly that cost.

    ``codes`` [segment, turn] are role * 4 + fault, padded at the end; ``exits`` [segment, state] is what each state costs at
    the end, or _FAR. Layer after layer, each turn's set comes from the sets of the next turn and of cheaper layers: kept
    turns within the layer, reroled, inserted and deleted ones from three or four layers below.
    """
    n, m = codes.shape
    out = np.zeros((DELETE * m + 24, m + 1, n), np.uint8)  # all turns deleted, and the most that states differ by at the end
    bits = (1 << np.arange(4)).astype(np.uint8)
    role, fault, pad = np.minimum(codes >> 2, 3), codes & 3, codes == _PAD
    stays, cut = (fault == NONE) | (fault == CUT), fault == CUT
    none = np.zeros(n, np.uint8)
    below = lambda c, i: out[c, i] if c >= 0 else none
    for c in range(len(out)):
        out[c, m] = ((exits == c) * bits).sum(1)
        for i in range(m - 1, -1, -1):
            r, ok, t = role[:, i], stays[:, i], cut[:, i]
            kept = np.where(t, below(c - KEEP - TRUNCATED, i + 1), out[c, i + 1])
            found = np.where(ok, _KEPT[r, kept] | _CHOSEN[np.where(t, below(c - REROLE - TRUNCATED, i + 1), below(c - REROLE, i + 1))], 0)
            found = found | below(c - DELETE, i + 1) | _CHOSEN[below(c - INSERT, i)]
            out[c, i] = np.where(pad[:, i], out[c, i + 1], found)
    return out


def costs(codes: np.ndarray) -> np.ndarray:
    """[segment, from, to]: the cost of each segment between two states: the first layer that accepts, for each way to end."""
    n = len(codes)
    exits = np.where(np.eye(4, dtype=bool), 0, _FAR)
    made = layers(np.repeat(codes, 4, 0), np.tile(exits, (n, 1)))[:, 0].reshape(-1, n, 4)
    has = made[..., None] >> np.arange(4) & 1
    return np.where(has.any(0), has.argmax(0), _FAR).transpose(0, 2, 1)


def trace(codes: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, list[list[list[str]]]]:
    """([segment, state] after the segment, edits of each turn [segment][state]) of the ASCII-least cheapest edits from each state.

    Follows the bits down the layers: at each turn the least of D, I, K, R whose successor is in the layer that its cost leaves.
    """
    n, m = codes.shape
    made = layers(codes, exits - exits.min(1, keepdims=True))
    left = (made[:, 0][..., None] >> np.arange(4) & 1).argmax(0).ravel()
    seg, state = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    edits = [[""] * m for _ in range(4 * n)]
    kept_to, chosen_to = np.array([*(STEP[r] for r in ROLES), (-1,) * 4]), np.array(CHOICE)

    def can(c: np.ndarray, i: int, to: np.ndarray) -> np.ndarray:
        return (c >= 0) & (to >= 0) & (made[np.maximum(c, 0), i, seg] >> np.maximum(to, 0) & 1 > 0)

    for i in range(m):
        code = codes[seg, i].astype(np.int64)
        role, cut, stays = np.minimum(code >> 2, 3), code & 3 == CUT, (code & 3 == NONE) | (code & 3 == CUT)
        open_ = code != _PAD
        while open_.any():
            keep, chosen = kept_to[role, state], chosen_to[state]
            options = (
                ("D", can(left - DELETE, i + 1, state), DELETE + 0 * left, state),
                ("I", can(left - INSERT, i, chosen), INSERT + 0 * left, chosen),
                ("K", stays & can(left - KEEP - TRUNCATED * cut, i + 1, keep), KEEP + TRUNCATED * cut, keep),
                ("R", stays & can(left - REROLE - TRUNCATED * cut, i + 1, chosen), REROLE + TRUNCATED * cut, chosen),
            )
            undecided, state, left, again = open_, state.copy(), left.copy(), np.zeros_like(open_)
            for letter, possible, cost, to in options:
                now = undecided & possible
                for k in np.flatnonzero(now):
                    edits[k][i] += letter
                state[now], left[now] = to[now], left[now] - cost[now]
                undecided = undecided & ~now
                if letter == "I":
                    again = now
            open_ = again
    return state.reshape(n, 4), edits


def solve(conversations: list[bytes], block: int = 2048) -> list[tuple[int, list[str]]]:
    """(cost, edits of each turn and, last, those after all turns) of each conversation, a byte of role * 4 + fault for each turn.

    Segments' costs between states are composed from the end of a conversation to its start, as (min, +) products; each segment
    is then traced from every state it may be entered in, and the traces are joined from the start.
    """
    cells = [(i, c[k : k + SEGMENT]) for i, c in enumerate(conversations) for k in range(0, len(c), SEGMENT)]
    width = max((len(c) for _, c in cells), default=0)
    codes = np.full((len(cells), width), _PAD, np.uint8)
    for k, (_, c) in enumerate(cells):
        codes[k, : len(c)] = np.frombuffer(c, np.uint8)
    blocks = range(0, len(cells), block)
    made = np.concatenate([np.zeros((0, 4, 4), np.int64), *(costs(codes[k : k + block]) for k in blocks)])
    ends, last, total = np.zeros((len(cells), 4), np.int64), np.array(END), {}
    for k in range(len(cells) - 1, -1, -1):
        whose = cells[k][0]
        ends[k] = last if k + 1 == len(cells) or cells[k + 1][0] != whose else after
        after = np.minimum(_FAR, (made[k] + ends[k][None, :]).min(1))
        total[whose] = int(after[0])
    traced = [trace(codes[k : k + block], ends[k : k + block]) for k in blocks]
    exits, edits = np.concatenate([np.zeros((0, 4), np.int64), *(t[0] for t in traced)]), [e for t in traced for e in t[1]]
    out: list[list[str]] = [[] for _ in conversations]
    state = [0] * len(conversations)
    for k, (i, c) in enumerate(cells):
        out[i] += edits[4 * k + state[i]][: len(c)]
        state[i] = int(exits[k, state[i]])
    return [(total.get(i, END[0]), [*e, "I" * (END[q] // INSERT)]) for i, (e, q) in enumerate(zip(out, state, strict=True))]


# ---- tables ------------------------------------------------------------------------------------------------------


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with digest and code, role * 4 + fault; the first of blank, duplicate and truncated counts.

    A turn is a duplicate if one with its role and text stands before it. Blank turns aren't compared, so they are dealt by turn.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    end, initial = F.right(trimmed, F.lit(1)), F.substring("role", 1, 1)
    rows = turns.withColumns({"digest": F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.md5(F.col("text").cast("binary"))).cast("binary"))), "blank": trimmed == ""})
    same = Window.partitionBy("conv", "digest", F.when(F.col("blank"), F.xxhash64("turn"))).orderBy("turn")
    fault = F.when(F.col("blank"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~end.isin(*".!?"), CUT).otherwise(NONE)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumn("code", (role * 4 + fault).cast("int")).select("conv", "turn", "role", "text", "digest", "code")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive turns of a conversation as one row, of bounded size; (part, seq) names it and keeps the order."""
    seq, key, size, held = 0, None, 0, ([], [], [], [])
    kind = None

    def row() -> pa.RecordBatch:
        turns = [t for t in held[0] if t is not None]
        cells = ([key], [part], [seq], [bytes(held[3])], [min(turns, default=None)], [max(turns, default=None)], [len(set(turns))], [held[1]], [held[2]])
        kinds = (kind, pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["conv", "part", "seq", "codes", "first_turn", "last_turn", "turns", "roles", "texts"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turn, role, text, code, part in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "code", "part")), strict=True):
            if held[0] and (conv != key or len(held[0]) >= CHUNK_TURNS or size >= CHUNK_CHARS):
                yield row()
                seq, size, held = seq + 1, 0, ([], [], [], [])
            key = conv
            size += len(text)
            for h, v in zip(held, (turn, role, text, code), strict=True):
                h.append(v)
    if held[0]:
        yield row()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's chunks: each one's edits and the state it is entered in; with the first one, the whole's counts and audit."""
    for batch in batches:
        rows = [sorted(r, key=lambda c: (c["part"], c["seq"])) for r in batch.column("chunks").to_pylist()]
        whole = [b"".join(c["codes"] for c in r) for r in rows]
        out = {k: [] for k in ("at", "part", "seq", "edits", "state", *_COUNTS, "audit")}
        for i, (r, codes, (cost, edits)) in enumerate(zip(rows, whole, solve(whole), strict=True)):
            known = [c for c in r if c["turns"]]
            # Turns that go on in the next chunk are counted in both.
            distinct = sum(c["turns"] for c in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0
            fault = np.bincount(np.frombuffer(codes, np.uint8) & 3, minlength=4).tolist()
            role = np.frombuffer(codes, np.uint8).astype(int) >> 2
            legal = np.isin(role[:-1] * 4 + role[1:], (1, 6, 9))  # su, ua, au
            counts = (gaps, fault[BLANK], fault[DUPLICATE], fault[CUT], int((~legal).sum()), cost)
            at, state = 0, 0
            for k, c in enumerate(r):
                here = edits[at : at + len(c["codes"])] + ([edits[-1]] if k + 1 == len(r) else [])
                first = (*counts, "".join(edits)) if k == 0 else (None,) * (len(_COUNTS) + 1)
                for column, v in zip(out.values(), (i, c["part"], c["seq"], here, state, *first), strict=True):
                    column.append(v)
                for letter, code in [(x, codes[at + j] if j < len(c["codes"]) else 0) for j, e in enumerate(here) for x in e]:
                    state = state if letter == "D" else STEP[ROLES[code >> 2]][state] if letter == "K" else CHOICE[state]
                at += len(c["codes"])
        conv = batch.column("conv").take(pa.array(out.pop("at"), pa.int64()))
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), *(pa.int64(),) * len(_COUNTS), pa.string())
        yield pa.RecordBatch.from_arrays([conv, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["conv", *out])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the turns that its edits leave."""
    for batch in batches:
        out = []
        for row in batch.select(["roles", "texts", "edits", "state"]).to_pylist():
            made, state = [], row["state"]
            for j, letters in enumerate(row["edits"]):
                for x in letters:
                    if x == "D":
                        continue
                    if x == "K":
                        role = row["roles"][j]
                        state = STEP[role[0]][state]
                    else:
                        state = CHOICE[state]
                        role = "user" if state == 2 else "assistant"
                    made.append({"edit": x, "role": role, "text": "" if x == "I" else row["texts"][j]})
            out.append(made)
        kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq")), pa.array(out, kind)], ["conv", "part", "seq", "turns"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of chunks in order: text by text, so that no conversation is ever held as a whole."""
    key, total, begun, kind = None, None, False, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([total.hexdigest()])], ["conv", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turns in zip(batch.column("conv").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            if total is None or conv != key:
                if total is not None:
                    yield row()
                key, total, begun = conv, hashlib.sha256(), False
            for t in turns:
                total.update(f"{'\n' if begun else ''}{t['role']}:{t['text']}".encode())
                begun = True
    if total is not None:
        yield row()


class Repair(NamedTuple):
    """conversations: one row each with counts, cost, audit and digest; turns: (conv, position, edit, role, text) as repaired."""

    conversations: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame, listed: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Conversations repaired at the least cost, and what was wrong with them.

    Turns stand in order of their number, nulls first; equal ones by role and digest of the text. A turn may be kept (K, free), given
    the role user or assistant (R, 3) or deleted (D, 4; blank and duplicate ones must be), an empty turn of user or assistant inserted
    anywhere (I, 3); a truncated turn that isn't deleted costs 3 more. What is left must have the role initials (s?(ua)+)?. Of the
    cheapest edits the ASCII-least string of letters is taken. Counts: gaps, blank, duplicate, truncated (a turn's first fault),
    illegal (adjacent initials other than su, ua, au).

    A null role or text reads as one space; a null conversation is one of its own. ``listed`` names the conversations (one column, any
    repeats) to give a row to, all of ``turns`` if not given; one without turns has zeros, an empty audit and the digest of an empty string.
    Repeated rows are turns like others. Other columns don't matter. Empty tables give empty ones.

    Plan: turns are dealt out by range of (conversation, turn), so a conversation with a third of all rows spreads over a third of the
    tasks. Runs of its turns become rows of a stored table with one byte a turn beside the texts. Only these bytes meet by
    conversation, no more than its audit takes; edits go back to the runs, which are repaired where they are, and a digest
    streams over them. Turns meet by (conversation, text) once, to find repeats; nothing of a group is held.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    order = ("conv", "turn", "role", "digest")
    dealt = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    conv = StructField("conv", rows.schema["conv"].dataType)
    named = [conv, StructField("part", IntegerType()), StructField("seq", IntegerType())]
    held = lambda *names: [StructField(c, ArrayType(StringType())) for c in names]
    numbers = lambda *names: [StructField(c, LongType()) for c in names]
    made = StructType([*named, StructField("codes", BinaryType()), *numbers("first_turn", "last_turn", "turns"), *held("roles", "texts")])
    chunks = stored(dealt.select("conv", "turn", "role", "text", "code", "part").mapInArrow(_chunks, made), "chunks")
    small = chunks.groupBy("conv").agg(F.collect_list(F.struct("part", "seq", "codes", "first_turn", "last_turn", "turns")).alias("chunks"))
    found = StructType([*named, *held("edits"), StructField("state", IntegerType()), *numbers(*_COUNTS), StructField("audit", StringType())])
    solved = stored(small.mapInArrow(_solved, found), "edits")
    beside = chunks.select("conv", "part", "seq", "roles", "texts").join(solved.select("part", "seq", "edits", "state"), ["part", "seq"]).select("conv", "part", "seq", "roles", "texts", "edits", "state")
    turn = StructType([StructField(c, StringType()) for c in ("edit", "role", "text")])
    repaired = beside.mapInArrow(_repaired, StructType([*named, StructField("turns", ArrayType(turn))]))
    digests = repaired.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "turns").mapInArrow(_digests, StructType([conv, StructField("repaired_sha256", StringType())]))
    whole = solved.where("audit IS NOT NULL").select("conv", *_COUNTS, "audit").alias("w").join(digests.alias("d"), F.col("w.conv").eqNullSafe(F.col("d.conv"))).select("w.*", "repaired_sha256")
    if listed is not None:
        ids = listed.select(F.col(listed.columns[0]).alias("id")).distinct()
        whole = ids.join(whole, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("id", "conv")
    empty = hashlib.sha256().hexdigest()
    whole = whole.select(F.col("conv").alias(conv_col), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
    place: Column = F.struct("part", "seq", "at").alias("position")
    return Repair(whole, repaired.select("conv", "part", "seq", F.posexplode("turns").alias("at", "t")).select(F.col("conv").alias(conv_col), place, "t.edit", "t.role", "t.text"))
