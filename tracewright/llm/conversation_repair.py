"""Repair of conversations: the cheapest edits after which turns alternate as `(system? (user assistant)+)?`, by initials of roles.

A row that is blank or repeats an earlier one of its conversation must go; any other may stay as it is, get the role that its place needs, or go; turns
with an empty text may be put in anywhere. Of the cheapest sequences of edits the one whose initials (D, I, K, R) come first in ASCII order is taken.

The method is square-root checkpointed dynamic programming. The cost of the rest from each of four states is a vector; going backward, only the vectors at
checkpoints are held. Going forward, the vectors between two checkpoints are computed again, and the first letter that keeps the cost tight is emitted. Letter and
state give the next state, and of equally cheap sequences none is another's beginning, so that the first tight letter is the right one.

Rows are sorted by range, so that a conversation may run over any number of tasks and no task holds more than its range. A conversation within one task is repaired there. Others are
cut into pieces, and so is a conversation of more than PIECE_ROWS rows: each piece's step from the vector at its end to the one at its beginning is a 4 x 4 table of
costs. These tables are chained backward along the conversation, which gives each piece the vector at its end, a checkpoint of the whole; each piece
is then walked from all four states at once, in parallel; and the walks are chained forward.

Cases: a null role or text counts as one space, null turns come first, ties are ordered by role and then text; repeated rows are counted and travel as one; rows of the null id are one
conversation; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, SALTS, col, written

#: Rows, and bytes of text, after which a conversation is cut within a task.
PIECE_ROWS, PIECE_TEXT = 4_096, 4 << 20
# Costs of edits and what marks the end of a sentence.
DELETE, REROLE, INSERT, UNFINISHED = 3, 2, 2, 1
ENDS, SPACES = ".!?", " \t\n\x0b\x0c\r"
#: Costs that can't be reached.
NEVER = 1 << 60
#: States: nothing yet, after the system's turn, after a user's turn, after a whole pair. The last and the first may end.
START, SYSTEM, USER, PAIR = range(4)
#: The state after a turn of each initial, by state.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIR}, {"u": USER})
#: The state after the turn that a state lacks.
NEEDED = (USER, USER, PAIR, USER)
LEGAL = frozenset(("su", "ua", "au"))
#: A row as one byte: its place in INITIALS, and 4 more if it is unfinished; or why it must go.
INITIALS, REPEATED, BLANK = "sua", 8, 9

Vector = tuple[int, int, int, int]


def _with_inserts(a: int, b: int, c: int, d: int) -> Vector:
    """Costs of the rest by state, where turns may be put in first."""
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


#: The costs after the last row.
AT_END = _with_inserts(0, NEVER, NEVER, 0)


def before(code: int, rest: Vector) -> Vector:
    """The costs before a row, from those after it."""
    a, b, c, d = rest
    if code >= REPEATED:
        return _with_inserts(a + DELETE, b + DELETE, c + DELETE, d + DELETE)
    more, initial = (UNFINISHED, code - 4) if code >= 4 else (0, code)
    user, pair = c + REROLE + more, d + REROLE + more
    best = [min(a + DELETE, user), min(b + DELETE, user), min(c + DELETE, pair), min(d + DELETE, user)]
    if initial == 0:
        best[START] = min(best[START], b + more)
    elif initial == 1:
        user = c + more
        best[START], best[SYSTEM], best[PAIR] = min(best[START], user), min(best[SYSTEM], user), min(best[PAIR], user)
    elif initial == 2:
        best[USER] = min(best[USER], d + more)
    return _with_inserts(*best)


def checkpoints(codes: bytes, end: Vector) -> tuple[int, list[Vector]]:
    """The distance of checkpoints and the vectors there, the first before row 0."""
    every = math.isqrt(max(1, len(codes) - 1)) + 1
    held, vector = [], end
    for i in range(len(codes) - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % every == 0:
            held.append(vector)
    return every, held[::-1]


def walk(codes: bytes, end: Vector, state: int) -> tuple[str, int]:
    """The cheapest edits from a state, and the state after them. end: the costs of what follows the rows."""
    every, held = checkpoints(codes, end)
    held.append(end)
    made: list[str] = []
    for block, first in enumerate(range(0, len(codes), every)):
        rows = codes[first : first + every]
        vectors = [held[block + 1]]
        for code in reversed(rows):
            vectors.append(before(code, vectors[-1]))
        now = vectors.pop()
        for code in rows:
            rest = vectors.pop()
            while now[state] != DELETE + rest[state] and now[state] == INSERT + now[NEEDED[state]]:
                made.append("I")
                state = NEEDED[state]
            if now[state] == DELETE + rest[state]:
                made.append("D")
            else:
                more, initial = divmod(code, 4)
                kept = AFTER[state].get(INITIALS[initial] if initial < 3 else "")
                if kept is not None and now[state] == more * UNFINISHED + rest[kept]:
                    made.append("K")
                    state = kept
                else:
                    made.append("R")
                    state = NEEDED[state]
            now = rest
    return "".join(made), state


def closed(state: int) -> str:
    """The edits that end a conversation from a state."""
    return {START: "", PAIR: "", USER: "I", SYSTEM: "II"}[state]


def applied(edits: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> tuple[list[str], list[str]]:
    """The roles and texts that the edits make of rows, from a state on."""
    out_roles, out_texts, at = [], [], 0
    for edit in edits:
        needed = "assistant" if state == USER else "user"
        if edit == "K":
            out_roles.append(roles[at])
            out_texts.append(texts[at])
            state = AFTER[state][roles[at][0]]
        elif edit != "D":
            out_roles.append(needed)
            out_texts.append("" if edit == "I" else texts[at])
            state = NEEDED[state]
        at += edit != "I"
    return out_roles, out_texts


def joined(roles: Sequence[str], texts: Sequence[str]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode()


class Counts(NamedTuple):
    """What is counted over a conversation's rows before its repair; first and last are for the seams between pieces."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None
    last_initial: str | None = None

    def then(self, other: Counts) -> Counts:
        """Both pieces' counts, one after the other."""
        seam = self.last_initial is not None and other.first_initial is not None and self.last_initial + other.first_initial not in LEGAL
        same = self.last_turn is not None and self.last_turn == other.first_turn
        sums = (a + b for a, b in zip(self[:3], other[:3], strict=True))
        ends = (self.first_turn if self.first_turn is not None else other.first_turn, other.last_turn if other.last_turn is not None else self.last_turn)
        ends += (self.first_initial if self.first_initial is not None else other.first_initial, other.last_initial if other.last_initial is not None else self.last_initial)
        return Counts(*sums, self.illegal + other.illegal + seam, self.turns + other.turns - same, *ends)

def counted(code: int, turn: int | None, initial: str, copies: int) -> Counts:
    """Of one row and its copies, which are duplicates if the row isn't blank."""
    blank = copies if code == BLANK else 0
    duplicate = 0 if code == BLANK else copies - 1 + (code == REPEATED)
    illegal = (copies - 1) * (initial * 2 not in LEGAL)
    return Counts(blank, duplicate, int(4 <= code < REPEATED), illegal, int(turn is not None), turn, turn, initial, initial)


def faults(text: Column, repeated: Column, role: Column) -> Column:
    """A row's byte: by its first fault (blank, repeated, unfinished), else by its initial."""
    bare = F.rtrim(text, F.lit(SPACES))
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    unfinished = ~F.substring(bare, -1, 1).isin(*ENDS)
    return F.when(bare == "", BLANK).when(repeated, REPEATED).otherwise(place + F.when(unfinished, 4).otherwise(0))


def _with_first_turn(rows: DataFrame) -> DataFrame:
    """Adds `repeated`: an earlier turn of the conversation has the same role and text.

    Which (conversation, role, text) stand in several turns is counted from hashes of 256 bits; these few are broadcast, or dealt by salt.
    """
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.length("role").cast("string"), "role", "text"), 256))
    turns = keyed.select("key", "turn").groupBy("key").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("none"))
    several = turns.where(F.col("least").isNotNull() & (F.col("none") | (F.col("least") < F.col("most")))).select("key", F.struct(F.when(~F.col("none"), F.col("least")).alias("turn")).alias("first"))
    several = written(several, "repeated-turns")
    if several.count() <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(several), "key", "left")
    else:
        copies = several.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        found = keyed.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS).cast("long"))).join(copies, ["key", "salt"], "left").drop("salt")
    return found.withColumn("repeated", F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first", "key")


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_PIECE = f"part int, no int, whole boolean, codes binary, step array<long>, copies array<long>, roles array<string>, texts array<string>, audit string, cost long, sha256 string, {_COUNTS}"


class _Piece:
    """Rows of a conversation that follow each other, while they are gathered."""

    def __init__(self, conv: object):
        self.conv, self.codes, self.copies, self.roles, self.texts, self.size, self.counts = conv, bytearray(), [], [], [], 0, Counts()

    def add(self, turn: int | None, role: str, text: str, copies: int, code: int) -> None:
        self.codes.append(code)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        self.counts = self.counts.then(counted(code, turn, role[:1], copies))

    def row(self, part: int, no: int, whole: bool) -> dict:
        codes = bytes(self.codes)
        row = {"conv": self.conv, "part": part, "no": no, "whole": whole, "codes": codes, "copies": self.copies} | self.counts._asdict()
        if not whole:
            ends = [tuple(0 if i == j else NEVER for i in range(4)) for j in range(4)]
            step = [min(cost, NEVER) for end in ends for cost in _start(spelled(codes, self.copies), end)]
            return row | {"step": step, "roles": self.roles, "texts": self.texts}
        full = spelled(codes, self.copies)
        audit, state = walk(full, AT_END, START)
        audit += closed(state)
        roles, texts = applied(compressed(audit, self.copies), START, self.roles, self.texts)
        return row | {"roles": roles, "texts": texts, "audit": audit, "cost": _start(full, AT_END)[START], "sha256": hashlib.sha256(joined(roles, texts)).hexdigest()}


def spelled(codes: bytes, copies: Sequence[int]) -> bytes:
    """A byte for each copy: those after a row's first are repeated, or blank like it."""
    if all(n == 1 for n in copies):
        return codes
    return b"".join(bytes([c]) + bytes([BLANK if c == BLANK else REPEATED]) * (n - 1) for c, n in zip(codes, copies, strict=True))


def compressed(edits: str, copies: Sequence[int]) -> str:
    """The edits without the deletions of copies, for rows that are held once."""
    if all(n == 1 for n in copies):
        return edits
    out, at, left = [], 0, 0
    for edit in edits:
        if edit == "I":
            out.append(edit)
        elif left:
            left -= 1
        else:
            out.append(edit)
            left, at = copies[at] - 1, at + 1
    return "".join(out)


def _start(codes: bytes, end: Vector) -> Vector:
    vector = end
    for code in reversed(codes):
        vector = before(code, vector)
    return vector


def pieces_of(df: DataFrame, conv: str, turn: str, role: str, text: str, piece_rows: int, piece_text: int) -> DataFrame:
    """Repaired whole conversations and pieces of others, in the conversations' order by (part, no)."""
    rows = df.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), *(F.coalesce(col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    rows = _with_first_turn(rows).groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"), F.first("repeated").alias("repeated"))
    rows = rows.select("conv", "turn", "role", "text", "copies", faults(F.col("text"), F.col("repeated"), F.col("role")).alias("code"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    schema = T.StructType([ranged.schema["conv"], *T._parse_datatype_string(_PIECE).fields])
    columns = schema.names

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, no, cut, out, size = None, 0, 0, True, [], 0  # cut: earlier rows of the held conversation may be elsewhere

        def emit(whole: bool) -> None:
            nonlocal no, size
            out.append(held.row(part, no, whole))
            no += 1
            size += held.size

        for batch in batches:
            arrow = _arrow_schema(columns, batch.schema.field("conv").type)
            names = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "code", "part")]
            for c, turn_, role_, text_, copies, code, part in zip(*names, strict=True):  # noqa: B007, B020
                if held is not None and held.conv != c:
                    emit(not cut)
                    held, cut = None, False
                elif held is not None and (len(held.codes) >= piece_rows or held.size >= piece_text):
                    emit(False)
                    held, cut = None, True
                if size >= piece_text or len(out) >= piece_rows:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
                held = held or _Piece(c)
                held.add(turn_, role_, text_, copies, code)
        if held is not None:
            emit(False)  # the next task may have more of it
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ranged.mapInArrow(gathered, schema)


_INT, _LONG, _TEXT = pa.int32(), pa.int64(), pa.string()
_ARROW = {"part": _INT, "no": _INT, "seq": _INT, "whole": pa.bool_(), "codes": pa.binary(), "audit": _TEXT, "sha256": _TEXT, "first_initial": _TEXT, "last_initial": _TEXT, "exits": pa.list_(_INT)}
_ARROW |= {c: pa.list_(_LONG) for c in ("step", "copies", "end")} | {c: pa.list_(_TEXT) for c in ("roles", "texts", "audits")}


def _arrow_schema(names: Sequence[str], conv: pa.DataType) -> pa.Schema:
    """Of columns by name; the conversation's id has the type that the caller's table gives it, all others not listed are long."""
    return pa.schema([(c, conv if c == "conv" else _ARROW.get(c, _LONG)) for c in names])


def _streamed(df: DataFrame, ascending: bool, schema: T.StructType, step) -> DataFrame:
    """Each conversation's pieces in order through step(rows of one conversation), a generator of rows; a task holds one batch at a time."""
    columns = schema.names
    order = [F.col("conv"), *(F.col(c).asc() if ascending else F.col(c).desc() for c in ("part", "no"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None

        def rows() -> Iterator[dict]:
            nonlocal arrow
            for batch in batches:
                arrow = _arrow_schema(columns, batch.schema.field("conv").type)
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        out = []
        for made in _by_conversation(rows(), step):
            out.append(made)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def _by_conversation(rows: Iterator[dict], step) -> Iterator[dict]:
    """step gets None after a conversation's last piece."""
    state, last = None, None
    for row in rows:
        if last is not None and last["conv"] != row["conv"]:
            yield from step(state, last, None)[1]
            state = None
        state, made = step(state, last, row)
        yield from made
        last = row
    if last is not None:
        yield from step(state, last, None)[1]


def _backward(state, last, row):
    """Gives each piece the costs at its end. state: the costs at the beginning of the piece that follows."""
    if row is None:
        return None, []
    end = state or AT_END
    step = row["step"]
    start = tuple(min(min(step[4 * j + i] + end[j], NEVER) for j in range(4)) for i in range(4))
    return start, [{"conv": row["conv"], "part": row["part"], "no": row["no"], "end": list(end), "cost": start[START]}]


def _forward(state, last, row):
    """Chooses each piece's walk by the state that the one before ends in; gives its repaired rows and, at last, the conversation's row."""
    if row is None:
        at, audits, digest, counts, cost, begun = state
        made, (roles, texts) = [], applied(closed(at), at, [], [])
        if roles:
            digest.update((b"\n" if begun else b"") + joined(roles, texts))
            made.append({"conv": last["conv"], "part": last["part"], "no": last["no"], "seq": 1, "roles": roles, "texts": texts})
        return None, [*made, {"conv": last["conv"], "audit": "".join(audits) + closed(at), "cost": cost, "sha256": digest.hexdigest()} | counts._asdict()]
    at, audits, digest, counts, cost, begun = state or (START, [], hashlib.sha256(), Counts(), row["total"], False)
    edits = row["audits"][at]
    roles, texts = applied(compressed(edits, row["copies"]), at, row["roles"], row["texts"])
    if roles:
        digest.update((b"\n" if begun else b"") + joined(roles, texts))
    audits.append(edits)
    counts = counts.then(Counts(*(row[f] for f in Counts._fields)))
    return (row["exits"][at], audits, digest, counts, cost, begun or bool(roles)), [{"conv": row["conv"], "part": row["part"], "no": row["no"], "seq": 0, "roles": roles, "texts": texts}]


def _walked(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrow = _arrow_schema(columns, batch.schema.field("conv").type)
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            codes, end = spelled(row.pop("codes"), row["copies"]), tuple(row.pop("end"))
            walks = [walk(codes, end, state) for state in range(4)]
            yield pa.RecordBatch.from_pylist([row | {"audits": [edits for edits, _ in walks], "exits": [state for _, state in walks]}], schema=arrow)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS, piece_text: int = PIECE_TEXT) -> tuple[DataFrame, DataFrame]:
    """Two tables: the conversations, and their repaired turns in pieces.

    Conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, and sha256 of the repaired turns (`role:text`, by newlines). Pieces: conv, roles, texts,
    in the order of (part, no, seq). The digest of a cut conversation is taken piece by piece in one stream, as its function has no other way.
    """
    found = written(pieces_of(df, conv, turn, role, text, piece_rows, piece_text), "conversation-pieces")
    cut, kind = found.where("NOT whole"), found.schema["conv"]
    ends = _streamed(cut.select("conv", "part", "no", "step"), False, T.StructType([kind, *T._parse_datatype_string("part int, no int, end array<long>, cost long").fields]), _backward)
    ends = written(ends, "conversation-ends")
    totals = ends.groupBy("conv").agg(F.min_by("cost", F.struct("part", "no")).alias("total")).withColumnRenamed("conv", "key")
    held = cut.drop("step", "whole", "audit", "cost", "sha256").join(ends.select("part", "no", "end"), ["part", "no"])
    schema = T.StructType([f for f in held.schema.fields if f.name not in ("codes", "end")] + T._parse_datatype_string("audits array<string>, exits array<int>").fields)
    columns = schema.names
    walked = held.mapInArrow(lambda batches: _walked(batches, columns), schema)
    walked = walked.join(totals, F.col("conv").eqNullSafe(F.col("key"))).drop("key")
    over = T.StructType([kind, *T._parse_datatype_string(f"part int, no int, seq int, roles array<string>, texts array<string>, audit string, cost long, sha256 string, {_COUNTS}").fields])
    chosen = written(_streamed(walked, True, over, _forward), "conversation-repairs")
    names = ("turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")
    both = found.where("whole").select("conv", *names).unionByName(chosen.where("part IS NULL").select("conv", *names))
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.try_add(F.try_subtract("last_turn", "first_turn"), F.lit(1) - F.col("turns")))
    pieces = found.where("whole").select("conv", "part", "no", F.lit(0).alias("seq"), "roles", "texts").unionByName(chosen.where("part IS NOT NULL").select("conv", "part", "no", "seq", "roles", "texts"))
    return both.select("conv", gaps.alias("gaps"), *names[3:]), pieces


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """A row per repaired turn: conv, place (to sort by), role, text."""
    rows = pieces.select("conv", "part", "no", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "turn"))
    return rows.select("conv", F.struct("part", "no", "seq", "pos").alias("place"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))
