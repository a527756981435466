"""Repair of conversations against a plain search over whole conversations."""

import hashlib
import heapq
import random
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from spindle.llm import conversation_repair
from spindle.llm.conversation_repair import conversation_audits, repaired_turns
from spindle.llm.queries import damaged, op12_repair
from spindle.llm.turn_search import ENDS, START, TAILS, search

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
NOTHING = hashlib.sha256(b"").hexdigest()
ROWS = "conv_id long, turn long, role string, text string, key string, place string, digest string, n string, tail string"


def plain_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, letters, lines) by always following the cheapest letters first."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, at, said, lines = heapq.heappop(heap)
        if at == len(turns) and (not said or said.endswith("a")):
            return cost, letters, lines
        if (at, said[-1:]) in seen:
            continue
        seen.add((at, said[-1:]))
        fits = "assistant" if said.endswith("u") else "user"
        heapq.heappush(heap, (cost + 2, letters + "I", at, said[-1:] + fits[0], (*lines, f"{fits}:")))
        if at == len(turns):
            continue
        role, text, fault = turns[at]
        heapq.heappush(heap, (cost + 3, letters + "D", at + 1, said, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = fault == "truncated"
        if role[:1] == fits[0] or (role[:1] == "s" and not said):
            heapq.heappush(heap, (cost + more, letters + "K", at + 1, said[-1:] + role[0], (*lines, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, said[-1:] + fits[0], (*lines, f"{fits}:{text}")))


def plain(rows, ids):
    out = []
    for conv in ids:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).digest()))
        turns, seen = [], set()
        for _, role, text in mine:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {t for t, *_ in mine if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = [sum(f == kind for *_, f in turns) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in pairwise(turns))
        cost, letters, lines = cheapest(turns)
        out.append((conv, gaps, *faults, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", "v") for r in rows], ROWS)


def random_rows(rng, conversations, most):
    texts = ["Yes.", "No", "Why?", "", " \n", "Long. " * 40, "é!", "no end \t", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Uther", None, "u"]
    rows = []
    for conv in conversations:
        for turn in range(rng.randrange(most)):
            number = rng.choice([turn, turn, turn, turn * 3, None, turn // 2])
            rows.append((conv, number, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn}."))
    return rows + rng.sample(rows, len(rows) // 10)


def test_search_against_the_plain_one():
    rng = random.Random(7)
    names = {"b": "blank", "d": "duplicate", "t": "truncated", ".": ""}
    for _ in range(400):
        turns = [rng.choice("suao") + rng.choice("bdt...") for _ in range(rng.randrange(12))]
        cost, letters, state = search(turns, START, ENDS)
        assert (cost, letters + TAILS[state]) == cheapest([(t[0], "", names[t[1]]) for t in turns])[:2]


@pytest.mark.parametrize("piece", [1, 3, 128])
def test_random_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rng = random.Random(piece)
    rows = random_rows(rng, [*range(30), None, -4], 14)
    ids = [*range(30), None, -4, 77]
    df = frame(spark, rows)
    known = frame(spark, [(i, None, None, None) for i in ids])
    assert collected(conversation_audits(df, known)) == plain(rows, ids)


def test_long_conversation_and_many_copies(spark):
    rng = random.Random(2)
    rows = random_rows(rng, [5], 600) + [(6, 3, "user", "Again.")] * 500 + [(6, 4, "assistant", "Good.")] + [(7, i, "user", "Same.") for i in range(300)]
    assert collected(conversation_audits(frame(spark, rows).repartition(6))) == plain(rows, [5, 6, 7])


def test_query_on_the_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op12_repair(spark, FOLDER)) == plain(plain_damaged(rows), {r[0] for r in rows})


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3, 4) for t in (None, *range(9)) for r, x in (("user", None), (None, "A. B!"))]
    assert collected(damaged(frame(spark, rows))) == sorted(plain_damaged(rows), key=repr)


def test_conversations_without_rows_and_none(spark):
    empty = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert collected(conversation_audits(empty)) == []
    assert collected(conversation_audits(empty, frame(spark, [(3, None, None, None)]))) == [(3, 0, 0, 0, 0, 0, 0, "", NOTHING)]


def test_repaired_turns_are_given(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 5, "assistant", "Yes."), (1, 6, "user", " "), (1, 7, "user", "Bye."), (2, 0, "tool", "Ran.")]
    got = repaired_turns(frame(spark, rows)).orderBy("conv_id", "place").collect()
    first = [(r["place"], r["edit"], r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == 1]
    assert first == [(0, "K", 0, "system", "Be brief."), (1, "K", 1, "user", "Hi."), (2, "I", None, "assistant", ""), (3, "K", 2, "user", "Hello?"), (4, "K", 5, "assistant", "Yes."), (5, "K", 7, "user", "Bye."), (6, "I", None, "assistant", "")]
    assert [r["role"] for r in got if r["conv_id"] == 2] == []


def test_other_column_names(spark):
    df = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    assert conversation_audits(df, None, "c", "t", "r", "x").first()["audit"] == "KK"
