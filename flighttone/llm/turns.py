"""Repair of conversations whose rows are missing, repeated, blank or out of turn.

A conversation must read ``(s?(ua)+)?``: perhaps a system row, then user and assistant in
turn.  The cheapest edits are a shortest path over rows and the four states of
that pattern.  Rows are numbered in each conversation by a range sort and dealt to blocks of
some square root of the conversation's length.  Each block gives the costs of crossing it; from
these, backward cost vectors are stored at the blocks' ends only.  Every block
is then recomputed from its vector, walking forward from each state it may be entered in, and
the walks that meet are taken.  No task holds more than a block or the list of a
conversation's blocks, but where a whole result has to be one value (``audit``, a digest).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.scale import join_unique, materialize, with_position

#: What edits cost, and characters that end a sentence or are blank.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a block at least; longer conversations have blocks of the square root of their rows.
BLOCK_ROWS = 1024
#: Rows and bytes of the texts handed to a task at once.
BATCH_ROWS = 500

#: States: nothing yet, after the system row, after a user's, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NEVER = 1 << 60
_INITIALS = "sua?"
#: Kinds of rows: sound, truncated, to be deleted.
_SOUND, _TRUNCATED, _BAD = range(3)
_Vector = tuple[int, int, int, int]


def _code(initial: str, kind: int) -> int:
    return 3 * _INITIALS.index(initial) + kind


def _row_edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row met in a state but insertions before it: letter, cost, state after it."""
    initial, kind = _INITIALS[code // 3], code % 3
    out = [("D", DELETE, state)]
    if kind != _BAD:
        extra = CUT if kind == _TRUNCATED else 0
        if (initial, state) == ("s", _START):
            out.append(("K", extra, _SYSTEM))
        elif initial in "ua" and _NEXT[state] == (_USER if initial == "u" else _ASSISTANT):
            out.append(("K", extra, _NEXT[state]))
        out.append(("R", REROLE + extra, _NEXT[state]))
    return out


def _with_inserts(costs: list[int]) -> _Vector:
    """Costs where rows may be inserted first; three in a row lead nowhere new."""
    out = list(costs)
    for state in range(4):
        at = state
        for n in (1, 2):
            at = _NEXT[at]
            out[state] = min(out[state], n * INSERT + costs[at])
    return tuple(min(c, _NEVER) for c in out)


#: Costs from the end of a conversation.
END: _Vector = _with_inserts([0, _NEVER, _NEVER, 0])


@functools.lru_cache(1 << 16)
def _back(code: int, after: _Vector) -> _Vector:
    return _with_inserts([min(c + after[to] for _, c, to in _row_edits(code, s)) for s in range(4)])


@functools.lru_cache(1 << 16)
def _before(code: int, after: _Vector) -> tuple[int, _Vector]:
    """Costs from before a row, given those after it: their least, and what each state adds to it."""
    costs = _back(code, after)
    least = min(costs)
    return least, tuple(_NEVER if c >= _NEVER >> 1 else c - least for c in costs)


@functools.lru_cache(1 << 16)
def _walk(code: int, state: int, after: _Vector) -> tuple[str, int]:
    """Least letters among the cheapest for a row, insertions before it included, and the state after it."""
    letters, costs = "", _back(code, after)
    while True:
        tight = [(x, to) for x, c, to in _row_edits(code, state) if c + after[to] == costs[state] < _NEVER]
        if INSERT + costs[_NEXT[state]] == costs[state] < _NEVER:
            tight.append(("I", -1))
        letter, to = min(tight)
        letters += letter
        if letter != "I":
            return letters, to
        state = _NEXT[state]


def _vectors(codes: bytes, after: _Vector) -> tuple[int, list[_Vector]]:
    """What every state pays in any case, and what it adds after each row of a block, from the last row backwards."""
    paid, held = 0, [after]
    for code in reversed(codes):
        least, after = _before(code, after)
        paid += least
        held.append(after)
    return paid, held[::-1]


def crossing(codes: bytes) -> np.ndarray:
    """Least costs from each state before a block to each state after it."""
    out = np.full((4, 4), _NEVER, np.int64)
    for to in range(4):
        only = tuple(0 if s == to else _NEVER for s in range(4))
        paid, held = _vectors(codes, only)
        out[:, to] = [min(paid + c, _NEVER) for c in held[0]]
    return out


def checkpoints(crossings: list[np.ndarray]) -> tuple[int, list[_Vector]]:
    """Backward costs at the end of each of a conversation's blocks, and the whole cost."""
    vector, held = np.array(END, np.int64), []
    for costs in reversed(crossings):
        held.append(vector)
        vector = np.minimum((costs + vector).min(axis=1), _NEVER)
    total = int(vector[_START])
    # What all states pay is left out, so that vectors stay few and small.
    return total, [tuple(int(c) for c in np.minimum(v - v.min(), _NEVER)) for v in held[::-1]]


def walk(codes: bytes, state: int, after: _Vector, last: bool) -> tuple[str, int]:
    """Letters of a block entered in a state, and the state it is left in; insertions at the end with the last."""
    _, vectors = _vectors(codes, after)
    out = []
    for code, vector in zip(codes, vectors[1:]):
        letters, state = _walk(code, state, vector)
        out.append(letters)
    while last and state in (_SYSTEM, _USER):
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


# -- rows ------------------------------------------------------------------------


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, two for a repeated one: ``key, turn, role, text, copy``.

    ``key`` is the conversation's id as text, a space for null.  The crc32 of ``conv_id:turn`` by
    20 decides: 0 drops the row, 1 empties its text, 2 takes sentence ends out, 3
    repeats it, 4 makes it the user's.
    """
    hit = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(_text("text"), ENDS, "")).otherwise(_text("text"))
    role = F.when(hit == 4, "user").otherwise(_text("role"))
    times = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.filter(hit != 0)
        .select(_text("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                F.explode(times).alias("copy"))
    )


#: Order of a conversation's rows: by turn, nulls first, and those of one turn by role and hashes of the text.
_ORDER = ("turn", "role", "t1", "t2", "copy")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _coded(rows: DataFrame) -> DataFrame:
    """Narrow rows with their place in all and code; duplicates, which are told by place, are not coded yet."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    ended = F.right(stripped, F.lit(1)).isin(*ENDS)
    initial = F.left(F.col("role"), F.lit(1))
    number = F.lit(3)
    for i, letter in enumerate("sua"):
        number = F.when(initial == letter, i).otherwise(number)
    kind = F.when(stripped == "", _BAD).when(ended, _SOUND).otherwise(_TRUNCATED)
    narrow = _hashed(rows).select(
        "key", *_ORDER, number.alias("initial"), kind.alias("kind"),
        # Equal rows are told apart, as a range of the sort could not be split between them.
        F.monotonically_increasing_id().alias("tie"),
    )
    return with_position(narrow, ["key", *_ORDER, "tie"], "place")


def _blocks(coded: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each block of a conversation: ``key, n, block, codes, blank, duplicate, truncated, illegal, first, last``."""
    firsts = coded.filter(F.col("kind") != _BAD).groupBy("key", "role", "t1", "t2").agg(F.min("place").alias("place"))
    length = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sqrt("n")))
    placed = (
        join_unique(coded.select("key", "place", "initial", "kind"), sizes.select("key", "n", "start"), ["key"], "n")
        .join(firsts.select("place", F.lit(True).alias("seen")), "place", "left")
        .withColumn("block", F.floor((F.col("place") - F.col("start")) / length))
    )
    blank = F.col("kind") == _BAD
    again = ~blank & F.col("seen").isNull()
    fact = F.struct("place", "initial", F.when(blank, 2).when(again, 3).otherwise(F.col("kind")).alias("kind"))
    held = placed.groupBy("key", "n", "block").agg(F.sort_array(F.collect_list(fact)).alias("facts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            facts = batch.column("facts")
            first = facts.offsets.to_numpy()
            flat = facts.flatten()
            initial = flat.field("initial").to_numpy().astype(np.int64)
            kind = flat.field("kind").to_numpy().astype(np.int64)
            first = first - first[0]
            codes = (3 * initial + np.minimum(kind, _BAD)).astype(np.uint8)
            pairs = initial[:-1] * 4 + initial[1:]
            wrong = np.append(~np.isin(pairs, [_INITIALS.index(a) * 4 + _INITIALS.index(b) for a, b in ("su", "ua", "au")]), False)
            wrong[first[1:-1] - 1] = False
            count = lambda flags: pa.array(np.add.reduceat(flags.astype(np.int64), first[:-1]) if len(flags) else flags.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), batch.column("block"),
                 pa.array([codes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
                 count(kind == 2), count(kind == 3), count(kind == _TRUNCATED), count(wrong),
                 pa.array(initial[first[:-1]]), pa.array(initial[first[1:] - 1])],
                names=["key", "n", "block", "codes", "blank", "duplicate", "truncated", "illegal", "first", "last"],
            )

    return held.mapInArrow(
        run, "key string, n long, block long, codes binary, blank long, duplicate long, truncated long, illegal long, "
        "first long, last long"
    )


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block."""
    for batch in batches:
        audits, costs = [], []
        for codes in batch.column("codes").to_pylist():
            paid, vectors = _vectors(codes, END)
            costs.append(paid + vectors[0][_START])
            audits.append(walk(codes, _START, END, True)[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("block"), pa.array([_START] * len(audits), pa.int64()), pa.array(audits, pa.string()),
             pa.array(costs, pa.int64())], names=["key", "block", "entry", "audit", "cost"],
        )


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [crossing(c).ravel().tolist() for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))],
                                         names=["key", "block", "costs"])


def _checked(table: pa.Table) -> pa.Table:
    """Backward vectors at the ends of one conversation's blocks, some square root of its rows."""
    table = table.sort_by("block")
    total, vectors = checkpoints([np.array(c, np.int64).reshape(4, 4) for c in table["costs"].to_pylist()])
    n = len(vectors)
    return pa.table({"key": table["key"], "block": table["block"], "after": pa.array([list(v) for v in vectors], pa.list_(pa.int64())),
                     "final": pa.array([i == n - 1 for i in range(n)]), "cost": pa.array([total if i == 0 else 0 for i in range(n)], pa.int64())})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block from each state it can be entered in: ``key, block, entry, leave, audit, cost``."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "block", "entry", "leave", "audit", "cost")}
        for key, block, codes, after, final, cost in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "codes", "after", "final", "cost"))):
            for entry in range(4) if block else (_START,):
                audit, leave = walk(codes, entry, tuple(after), final)
                for name, value in zip(out, (key, block, entry, leave, audit, cost)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema(
            [("key", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("audit", pa.string()), ("cost", pa.int64())]))


def _entered(table: pa.Table) -> pa.Table:
    """The state each of one conversation's blocks is entered in."""
    leave = {(b, e): x for b, e, x in zip(*(table[c].to_pylist() for c in ("block", "entry", "leave")))}
    state, entries = _START, []
    for block in range(max(b for b, _ in leave) + 1):
        entries.append(state)
        state = leave[block, state]
    return pa.table({"key": pa.array(table["key"].to_pylist()[:1] * len(entries), pa.string()),
                     "block": pa.array(range(len(entries)), pa.int64()), "entry": pa.array(entries, pa.int64())})


def audits(held: DataFrame) -> DataFrame:
    """Edits of every block of rows: ``key, block, entry, audit, cost``; the cost stands at a conversation's first block."""
    longer = F.col("n") > F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sqrt("n")))
    one = held.filter(~longer).select("key", "block", "codes").mapInArrow(
        _in_one, "key string, block long, entry long, audit string, cost long")
    many = held.filter(longer).select("key", "block", "codes")
    vectors = many.mapInArrow(_crossed, "key string, block long, costs array<long>").groupBy("key").applyInArrow(
        _checked, "key string, block long, after array<long>, final boolean, cost long")
    walked = materialize(many.join(vectors, ["key", "block"]).mapInArrow(
        _walked, "key string, block long, entry long, leave long, audit string, cost long"))
    entries = walked.select("key", "block", "entry", "leave").groupBy("key").applyInArrow(
        _entered, "key string, block long, entry long")
    return one.unionByName(walked.drop("leave").join(entries, ["key", "block", "entry"]))


def analyse(conversations: DataFrame) -> DataFrame:
    """Faults and edits of every conversation: ``conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows are those of :func:`damaged`, in the order of turns, nulls first; rows of one turn are
    ordered by role and a hash of the text, which only tells apart what the table does not.  Conversations
    without a row left have zeros and an empty audit.  Null ids are one conversation; null
    roles and texts are a space, so the text is blank; other columns are not read; an empty
    table gives no rows.
    """
    coded = _coded(damaged(conversations))
    # One row for each turn first, so that a long conversation is added up by many tasks.
    turns = coded.groupBy("key", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    sizes = materialize(turns.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("start").alias("start"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
    ))
    held = materialize(_blocks(coded, sizes))
    edits = audits(held)
    legal = [_INITIALS.index(a) * 4 + _INITIALS.index(b) for a, b in ("su", "ua", "au")]
    counts = held.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.struct("block", "first", "last"))).alias("ends"),
    )
    # Pairs of rows across the ends of blocks.
    pairs = F.transform("ends", lambda end, i: end["last"] * 4 + F.get("ends", i + 1)["first"])
    across = F.size(F.filter(pairs, lambda pair: ~pair.isin(*legal)))
    counts = counts.withColumn("illegal", F.col("illegal") + across).drop("ends")
    whole = edits.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("parts"))
    found = sizes.select("key", "gaps").join(counts, "key").join(
        whole.select("key", "cost", F.concat_ws("", F.col("parts.audit")).alias("audit")), "key")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), _text("conv_id").alias("key")).distinct()
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, "key", "left").select(
        "conv_id", "key", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"))


_ROLES = {_USER: "user", _ASSISTANT: "assistant"}


class _Conversation:
    """Applies an audit to the rows of one conversation, as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield _ROLES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = _SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[self.state]
        yield (role if letter == "K" else _ROLES[self.state]), text, letter

    rest = _inserted


def _streamed(conversations: DataFrame, analysed: DataFrame) -> DataFrame:
    """Conversations one after the other, the audit before the rows in their order, in bounded batches.

    A conversation stays in one task, as a digest of its whole text is one sequence; it
    passes through, and only its audit is held.
    """
    rows = _hashed(damaged(conversations)).select("key", *_ORDER, F.col("text"), F.lit(1).alias("part"), F.lit(None).cast("long").alias("conv_id"))
    heads = analysed.select(
        "key", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("t1"),
        F.lit(0).cast("long").alias("t2"), F.lit(0).alias("copy"), F.col("audit").alias("text"), F.lit(0).alias("part"), "conv_id",
    )
    both = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "part", *_ORDER)
    return both.select("key", "part", "conv_id", "role", "text")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, list[tuple[str, str, str]]]]:
    """Id, whether the conversation begins, and repaired rows, of a stream of heads and rows."""
    now, conv_id = None, None
    for batch in batches:
        for part, i, role, text in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "role", "text"))):
            if part == 0:
                if now is not None:
                    yield conv_id, False, list(now.rest())
                now, conv_id = _Conversation(text), i
                yield conv_id, True, []
            else:
                yield conv_id, False, list(now.row(role, text))
    if now is not None:
        yield conv_id, False, list(now.rest())


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired rows: ``conv_id, place, role, text, edit``, places from 0 on; see :func:`analyse`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        held, size, place = [], 0, 0
        for conv_id, begins, rows in _each(batches):
            place = 0 if begins else place
            for row in rows:
                held.append((conv_id, place, *row))
                place += 1
                size += len(row[1])
            if len(held) >= BATCH_ROWS or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return _streamed(conversations, materialize(analyse(conversations))).mapInArrow(
        run, "conv_id long, place long, role string, text string, edit string")


def digests(conversations: DataFrame) -> DataFrame:
    """:func:`analyse` with ``repaired_sha256``, of the repaired rows as ``role:text`` joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        out: list[tuple] = []
        now, conv_id, empty = None, None, True
        for i, begins, rows in _each(batches):
            if begins:
                if now is not None:
                    out.append((conv_id, now.hexdigest()))
                now, conv_id, empty = hashlib.sha256(), i, True
            for role, text, _ in rows:
                now.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if now is not None:
            out.append((conv_id, now.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    analysed = materialize(analyse(conversations))
    hashed = _streamed(conversations, analysed).mapInArrow(run, "conv_id long, repaired_sha256 string")
    keyed = hashed.withColumn("key", _text("conv_id")).drop("conv_id")
    return analysed.join(keyed, "key").drop("key")
