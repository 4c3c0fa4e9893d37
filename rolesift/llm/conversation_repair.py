"""Repair the turn structure of conversations by the cheapest edits.

Rows of a conversation are kept, given another role or deleted, and empty rows are inserted, until the
initials of the roles read ``(s?(ua)+)?``. The edits are found by iterative-deepening A*: a depth-first
search tries them in ASCII order under a bound on the cost, states that failed keep what they are known to
cost at least, and the bound rises to the least cost that went beyond it. The first path that is
accepted is the cheapest one, and of several the ASCII-least.

The search reads one byte per row: the initial of its role and its fault. Rows are dealt by ranges of
(conversation, turn), and a task cuts its stretch of a conversation into blocks of ``BLOCK_ROWS``. Most conversations
are one block. Of the others every block is searched by itself, between each two states at its ends; sums of these
costs tell what the rest costs behind each block, and with them as end costs a block's own search finds its part of the
cheapest path. Inserted rows belong to the block of the row they precede, so parts can be compared alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.shared import staged

BLOCK_ROWS = 512
INITIALS = "sua"  # anything else is the fourth kind
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 50

#: States: nothing yet, after s, after u, after a. What a kept initial leads to, and the role to give or insert.
START = 0
AFTER = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
GIVEN = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: At the end of a conversation: rows to insert until the initials are accepted.
END_INSERTS = ["", "II", "I", ""]
END = tuple(INSERT * len(letters) for letters in END_INSERTS)


def row_class(initial: str, fault: int) -> int:
    """One byte for the initial of a role and the fault of its row."""
    kind = INITIALS.find(initial) if initial else -1
    return 65 + 4 * (kind if kind >= 0 else 3) + fault


def _chains(state: int) -> list[tuple[int, int]]:
    """Inserts before a row that come back to no state: how many, and where they lead."""
    chain, seen = [(0, state)], {state}
    while GIVEN[chain[-1][1]][1] not in seen:
        seen.add(GIVEN[chain[-1][1]][1])
        chain.append((len(chain), GIVEN[chain[-1][1]][1]))
    return chain


def _moves(cls: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row with the inserts before it, in ASCII order: letters, cost, next state."""
    kind, fault = divmod(cls - 65, 4)
    left = LEFT_TRUNCATED if fault == TRUNCATED else 0
    found = []
    for n, at in _chains(state):
        found.append(("I" * n + "D", INSERT * n + DELETE, at))
        if fault not in (BLANK, DUPLICATE):
            found.append(("I" * n + "R", INSERT * n + REROLE + left, GIVEN[at][1]))
            if kind in AFTER[at]:
                found.append(("I" * n + "K", INSERT * n + KEEP + left, AFTER[at][kind]))
    return sorted(found)


MOVES = {65 + c: [_moves(65 + c, q) for q in range(4)] for c in range(16)}
#: No row costs less than its cheapest edit, whatever is around it.
LEAST = {c: min(cost for moves in by_state for _, cost, _ in moves) for c, by_state in MOVES.items()}


@lru_cache(maxsize=1 << 14)
def search(classes: bytes, entry: int, end: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The cheapest edits of the rows from state ``entry``, where ending in state q costs ``end[q]``.

    Returns the cost without that of the end, the letters, and the last state; None if no end can be reached."""
    n = len(classes)
    floor = [min(end)] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + LEAST[classes[i]]
    failed: dict[int, int] = {4 * n + q: end[q] for q in range(4)}  # what states are known to cost at least
    path: list[tuple[str, int, int]] = [("", 0, entry)] * n

    def accepts(i: int, state: int, left: int) -> bool:
        if i == n:
            return end[state] <= left
        least = FAR
        for move in MOVES[classes[i]][state]:
            _, cost, after = move
            place = 4 * (i + 1) + after
            need = failed.get(place, floor[i + 1])
            if cost + need <= left:
                if accepts(i + 1, after, left - cost):
                    path[i] = move
                    return True
                need = failed[place]
            least = min(least, cost + need)
        failed[4 * i + state] = least
        return False

    bound = failed.get(entry, floor[0])
    while bound < FAR and not accepts(0, entry, bound):
        bound = failed[entry]
    if bound >= FAR:
        return None
    last = path[-1][2] if n else entry
    return bound - end[last], "".join(letters for letters, _, _ in path), last


def illegal_pairs(classes: bytes) -> int:
    """Neighbours whose initials are not su, ua or au."""
    kinds = [(c - 65) // 4 for c in classes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:]))


def _cut_into_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks: key, block (ascending along a conversation), classes."""
    block = TaskContext.get().partitionId() << 32
    key, held, out = None, bytearray(), []

    def cut() -> None:
        nonlocal block
        if held:
            out.append({"key": key, "block": block, "classes": bytes(held)})
            block += 1
            held.clear()

    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("classes", pa.binary())])
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "initial", "fault", "later", "copies"))
        for own, initial, fault, later, copies in zip(*columns):
            if own != key:
                cut()
                key = own
            repeat = row_class(initial, fault if fault == BLANK else DUPLICATE)
            first = repeat if later else row_class(initial, fault)
            while copies:
                if len(held) == BLOCK_ROWS:
                    cut()
                held.append(first)
                first, copies = repeat, copies - 1
                more = min(copies, BLOCK_ROWS - len(held))
                held.extend(bytes([repeat]) * more)
                copies -= more
        if len(out) >= 1_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    cut()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """A written table of the blocks of all conversations; only digests of texts are moved.

    Equal rows of one turn become one row with a number first, so a repeated one is a single entry."""
    body = F.btrim("text", F.lit(WHITE))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    slim = rows.select("key", "turn", "role", "digest", fault.alias("fault"))
    same = slim.groupBy("key", "turn", "role", "digest").agg(F.first("fault").alias("fault"), F.count("*").alias("copies"))
    time = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    seen = same.groupBy("key", "role", "digest").agg(F.min(time).alias("first"), F.count("*").alias("turns"))
    seen = seen.filter("turns > 1").drop("turns")
    marked = same.join(seen, ["key", "role", "digest"], "left")
    later = F.coalesce(F.col("first") < time, F.lit(False))
    marked = marked.select("key", "turn", "role", "digest", "fault", "copies", later.alias("later"), F.left("role", F.lit(1)).alias("initial"))
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "initial", "fault", "later", "copies")
    return staged(dealt.mapInArrow(_cut_into_blocks, "key string, block long, classes binary"), "blocks")


def _search_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [search(c, START, END) for c in batch.column("classes").to_pylist()]
        cost = pa.array([c + END[q] for c, _, q in found], pa.int64())
        audit = pa.array([letters + END_INSERTS[q] for _, letters, q in found], pa.string())
        yield batch.append_column("cost", cost).append_column("audit", audit)


def _search_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block costs from each state to each state."""
    ends = [tuple(0 if q == to else FAR for q in range(4)) for to in range(4)]
    for batch in batches:
        costs = []
        for classes in batch.column("classes").to_pylist():
            found = [search(classes, q, end) for q in range(4) for end in ends]
            costs.append([f[0] if f else FAR for f in found])
        yield batch.select(["key", "block"]).append_column("costs", pa.array(costs, pa.list_(pa.int64())))


def _rest_behind(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation, what the rows behind each block cost by the state at its end."""
    pdf = pdf.sort_values("block")
    rest, out = list(END), []
    for costs in reversed(pdf["costs"].tolist()):
        out.append(rest)
        rest = [min(FAR, *(costs[4 * q + to] + rest[to] for to in range(4))) for q in range(4)]
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "rest": out[::-1]})


def _search_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the path in a block, from each state that may lead into it."""
    for batch in batches:
        rows = []
        for classes, rest in zip(batch.column("classes").to_pylist(), batch.column("rest").to_pylist()):
            rows.append([search(classes, q, tuple(rest)) or (FAR, "", 0) for q in range(4)])
        for name, at, kind in (("costs", 0, pa.int64()), ("parts", 1, pa.string()), ("exits", 2, pa.int64())):
            batch = batch.append_column(name, pa.array([[f[at] for f in found] for found in rows], pa.list_(kind)))
        yield batch.drop_columns(["rest"])


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation, the state that leads into each block, and the inserts behind the last one."""
    pdf = pdf.sort_values("block")
    state, entries = START, []
    for exits in pdf["exits"]:
        entries.append(state)
        state = int(exits[state])
    tails = [""] * (len(entries) - 1) + [END_INSERTS[state]]
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "entry": entries, "tail": tails})


def _edits(blocks: DataFrame) -> DataFrame:
    """key, block, classes, cost and audit of every block."""
    out = "key string, block long, classes binary, cost long, audit string"
    several = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    whole = blocks.join(several, "key", "left_anti").select("key", "block", "classes").mapInArrow(_search_whole, out)
    parts = staged(blocks.join(several, "key", "left_semi"), "long-conversations").select("key", "block", "classes")
    costs = parts.mapInArrow(_search_ends, "key string, block long, costs array<long>")
    rest = costs.groupBy("key").applyInPandas(_rest_behind, "key string, block long, rest array<long>")
    choices = "key string, block long, classes binary, costs array<long>, parts array<string>, exits array<long>"
    found = staged(parts.join(rest, ["key", "block"]).select("key", "block", "classes", "rest").mapInArrow(_search_parts, choices), "parts")
    entries = found.select("key", "block", "exits").groupBy("key").applyInPandas(_follow, "key string, block long, entry long, tail string")
    one = (F.col("entry") + 1).cast("int")
    joined = found.join(entries, ["key", "block"]).select(
        "key",
        "block",
        "classes",
        (F.element_at("costs", one) + INSERT * F.length("tail")).alias("cost"),
        F.concat(F.element_at("parts", one), "tail").alias("audit"),
    )
    return whole.unionByName(joined)


class _Conversation:
    """What is known of a conversation while its rows pass by in order."""

    def __init__(self, key: str):
        self.key, self.audit, self.classes, self.cost = key, bytearray(), bytearray(), 0
        self.at, self.state, self.lines, self.sha = 0, START, 0, hashlib.sha256()
        self.first = self.last = None
        self.turns = 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        self.lines += 1

    def give(self, text: str) -> None:
        role, self.state = GIVEN[self.state]
        self.line(role, text)

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == ord("I"):
            self.give("")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.inserts()
        letter = chr(self.audit[self.at])
        self.at += 1
        if letter == "K":
            self.line(role, text)
            self.state = AFTER[self.state][INITIALS.index(role[0])]
        elif letter == "R":
            self.give(text)

    def result(self) -> dict:
        self.inserts()
        faults = [(c - 65) % 4 for c in self.classes]
        return {
            "key": self.key,
            "gaps": self.last - self.first + 1 - self.turns if self.turns else 0,
            "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED),
            "illegal": illegal_pairs(bytes(self.classes)),
            "cost": self.cost,
            "audit": self.audit.decode(),
            "repaired_sha256": self.sha.hexdigest(),
        }


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "key string, " + ", ".join(f"{c} long" for c in _LONGS) + ", audit string, repaired_sha256 string"


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a conversation, then its rows in order; texts only pass through."""
    fields = [("key", pa.string()), *((c, pa.int64()) for c in _LONGS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    now: _Conversation | None = None
    out: list[dict] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "classes", "cost", "audit"))
        for key, turn, role, text, classes, cost, audit in zip(*columns):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(key)
            if audit is not None:
                now.audit += audit.encode()
                now.classes += classes
                now.cost += cost
            else:
                now.row(turn, role, text)
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
        out.clear()
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=pa.schema(fields))


def _key(conv: Column) -> Column:
    """The id as text, with a mark that tells a null from an empty text."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Faults and cheapest repair of every conversation in ``rows``.

    The first fault of a row counts: blank (only space, tab to carriage return), duplicate (role and text
    stood earlier in the conversation), truncated (the last other character is none of ``.!?``). Keep costs
    0, Rerole (to user or assistant) 2, Delete 3 and is forced for blank and duplicate rows, Insert (an empty row
    of user or assistant) 2; a truncated row that stays costs 1 more. Returns one row per conversation:
    ``<conv_col>``, gaps (missing turn numbers between the least and the greatest), blank, duplicate,
    truncated, illegal (neighbours whose role initials are not su, ua or au), cost, audit (initials of the
    edits in order; of several cheapest ones the ASCII-least) and repaired_sha256 (of the lines ``role:text``
    that remain, joined by line feeds; empty if none).

    * Rows go by turn, nulls first; rows of one turn by role and then the digest of their text, so ties
      are settled by content. Equal rows are duplicates of the first. Without any turn number gaps is 0.
    * A null role or text counts as one space, so a null text is blank. A null conversation id is a
      conversation of its own, and stays null. An empty role has no initial and cannot be kept.
    * Texts of any length pass a task one batch at a time. A conversation may have any number of rows: faults
      and searches are dealt in blocks. The last step streams its rows through one task, as they go into one
      hash; that task holds two bytes per row of it (the audit it returns, and the faults).
    * Other columns are not read. An empty table gives an empty result.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    taken = rows.select(
        _key(F.col(conv_col)).alias("key"),
        F.col(turn_col).cast("long").alias("turn"),
        space(role_col).alias("role"),
        space(text_col).alias("text"),
    ).withColumn("digest", F.unhex(F.md5("text")))
    edits = staged(_edits(_blocks(taken)), "edits")
    none = lambda kind: F.lit(None).cast(kind)
    lines = taken.withColumns({"block": F.lit(-1).cast("long"), "classes": none("binary"), "cost": none("long"), "audit": none("string")})
    heads = edits.withColumns({"turn": none("long"), "role": none("string"), "text": none("string"), "digest": none("binary")})
    order = [F.col("key"), F.col("audit").isNull(), F.col("block"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    streamed = heads.unionByName(lines).repartition("key").sortWithinPartitions(*order)
    columns = streamed.select("key", "turn", "role", "text", "classes", "cost", "audit")
    conv = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.schema[conv_col].dataType)
    return columns.mapInArrow(_apply, _RESULT).withColumn("key", conv).withColumnRenamed("key", conv_col)


def damage(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Break conversations in a fixed way, by crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user. Nulls count as one space, turn
    numbers and ids excepted, which only do so in the crc32. All columns stay."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(part(text_col), ".!?", "")).otherwise(part(text_col))
    role = F.when(draw == 4, "user").otherwise(part(role_col))
    times = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    changed = rows.select(
        *(text.alias(c) if c == text_col else role.alias(c) if c == role_col else F.col(c) for c in rows.columns),
        F.explode(F.array_repeat(F.lit(1), times)).alias("__times"),
    )
    return changed.drop("__times")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged rows, with a row of zeros for conversations that lost all of theirs."""
    found = repair_conversations(damage(rows))
    known = rows.select(_key(F.col("conv_id")).alias("_key"), "conv_id").groupBy("_key").agg(F.first("conv_id").alias("conv_id"))
    judged = found.withColumn("_key", _key(F.col("conv_id"))).drop("conv_id")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _LONGS}
    empty = hashlib.sha256(b"").hexdigest()
    return known.join(judged, "_key", "left").drop("_key").withColumns(
        {**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(empty))}
    )
