"""Conversation repair against plain code: all cheapest edits by dynamic programming over whole strings."""

import hashlib
import random
import zlib

import duckdb
import pytest

from rolesift.llm import conversation_repair as cr
from rolesift.llm.queries import QUERIES
from tests.llm.test_llm_queries import SF_DIR, pytestmark  # noqa: F401

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def plain_repair(rows):
    """Of one conversation's rows (turn, role, text): the result without its id."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    steps = {(q, c): n for q, c, n in [("", "s", "s"), ("", "u", "u"), ("s", "u", "u"), ("u", "a", "a"), ("a", "u", "u")]}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}  # by state: cost, letters, lines

    def better(table, state, item):
        if state not in table or item[:2] < table[state][:2]:
            table[state] = item

    def with_inserts(table):
        for _ in range(4):
            for state, (cost, letters, lines) in list(table.items()):
                for c in "ua":
                    if (state, c) in steps:
                        better(table, steps[state, c], (cost + 2, letters + "I", (*lines, full[c] + ":")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, letters, lines) in with_inserts(best).items():
            better(after, state, (cost + 3, letters + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault else 0
                if (state, role[:1]) in steps:
                    better(after, steps[state, role[:1]], (cost + extra, letters + "K", (*lines, f"{role}:{text}")))
                for c in "ua":
                    if (state, c) in steps:
                        better(after, steps[state, c], (cost + 2 + extra, letters + "R", (*lines, f"{full[c]}:{text}")))
        best = after
    cost, audit, lines = min(with_inserts(best)[q] for q in ("", "a") if q in best)
    turns = {t for t, _, _ in rows if t is not None}
    roles = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(roles, roles[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_all(rows):
    by_conv = {}
    for conv, *rest in rows:
        by_conv.setdefault(conv, []).append(rest)
    return {conv: plain_repair(own) for conv, own in by_conv.items()}


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(rng, n_convs, longest):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "s", None]
    texts = ["Yes.", "No!", "and so", " \n", "", None, "Why?  ", "one. two", "ok"]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '', '!'])}"
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [512, 3])
def test_random_conversations(spark, monkeypatch, block):
    """Blocks of three rows take the way of very long conversations."""
    rows = random_rows(random.Random(block), 250, 14)
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "assistant", "x."), (901, 5, "tool", "x"), (901, 5, "tool", "x")]
    monkeypatch.setattr(cr, "BLOCK_ROWS", block)
    cut = cr._cut_into_blocks

    def cut_short(batches):
        cr.BLOCK_ROWS = block  # in the worker
        return cut(batches)

    monkeypatch.setattr(cr, "_cut_into_blocks", cut_short)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(cr.repair_conversations(df)) == plain_all(rows)


def test_long_conversation_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"line {t}.", f"open {t}"])) for t in range(3_000)]
    df = spark.createDataFrame(rows + [(8, 0, "user", "Hi.")], SCHEMA)
    out = found(cr.repair_conversations(df))
    assert out == plain_all(rows + [(8, 0, "user", "Hi.")])


def test_registered_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall()
    expected = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | plain_all(plain_damage(rows))
    assert found(QUERIES["op12_conversation_repair"](spark, SF_DIR)) == expected


def test_damage(spark):
    rows = random_rows(random.Random(1), 60, 6) + [(None, None, None, None), (None, 3, "user", "a.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", __times string")
    got = [tuple(r) for r in cr.damage(df.withColumnRenamed("__times", "key")).drop("key").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_damage(rows)))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a." * 500_000, "x"), (1, 1, "assistant", "ok.", "y")], SCHEMA + ", audit string")
    row = cr.repair_conversations(df).first()
    assert (row.cost, row.audit) == (0, "KK")
    assert row.repaired_sha256 == hashlib.sha256(("user:" + "a." * 500_000 + "\nassistant:ok.").encode()).hexdigest()
    assert cr.repair_conversations(df.limit(0)).isEmpty()
    assert cr.repair_damaged(df.limit(0)).isEmpty()


def test_ascii_least_of_cheapest():
    one = lambda *rows: bytes(cr.row_class(initial, fault) for initial, fault in rows)
    sound = [("u", 0), ("a", 0)]
    assert cr.search(one(*sound), 0, cr.END) == (0, "KK", 3)
    assert cr.search(one(), 0, cr.END) == (0, "", 0)
    cost, letters, state = cr.search(one(("u", 0)), 0, cr.END)
    assert (cost + cr.END[state], letters + cr.END_INSERTS[state]) == (2, "KI")
    assert cr.search(one(("u", 1)), 2, (1 << 50, 0, 1 << 50, 1 << 50)) is None
