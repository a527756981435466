"""Conversations brought into the form that training wants, by the fewest edits.

Texts are read twice and cross the network once. Everything before that works on
facts of turns: their order, initial, fault and digest. Facts are sorted by range,
so that a conversation of any length is cut into pieces of bounded size, in many
tasks. The search for the edits runs on pieces, from the last to the first, since
a piece must know what each state at its end costs; a second pass from the first
to the last takes the answers that fit together. Both hold one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from spindle.llm.shared import staged
from spindle.llm.turn_search import ENDS, FITTING, KEPT, ROLES, START, TAILS, search

PIECE = 128  # turns of a conversation that are searched at once
SPACES = " \t\n\x0b\x0c\r"
TOGETHER = 4_000_000  # characters of the rows that go back to Spark at once

_TURN = [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]
_PIECES = pa.schema([("key", pa.string()), ("piece", pa.int64()), ("initials", pa.string()), ("faults", pa.string()), ("turns", pa.list_(pa.struct(_TURN)))])
_PATHS = pa.schema([*_PIECES, ("first", pa.bool_()), ("last", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_EDITS = pa.schema([("key", pa.string()), ("tail", pa.bool_()), *_TURN, ("new_role", pa.string()), ("before", pa.list_(pa.string())), ("found", pa.struct([*[(c, pa.int64()) for c in _NUMBERS], ("audit", pa.string())]))])
_REPAIRED = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _streamed(df: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema) -> DataFrame:
    """Rows of each partition through a generator, one by one and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for s in range(0, batch.num_rows, 1000) for row in batch[s : s + 1000].to_pylist())
        held, size = [], 0
        for row in step(rows):
            held.append(row)
            size += len(row.get("text") or "") + 100
            if size > TOGETHER:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def _by_key(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *order)


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, digest): nulls of role and text count as one space,
    the key of rows without a conversation is empty."""
    spaced = {"role": F.coalesce(F.col(role).cast("string"), F.lit(" ")), "text": F.coalesce(F.col(text).cast("string"), F.lit(" "))}
    key = F.coalesce(F.col(conv).cast("long").cast("string"), F.lit(""))
    rows = conversations.select(key.alias("key"), F.col(turn).cast("long").alias("turn"), *[c.alias(n) for n, c in spaced.items()])
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _facts(turns: DataFrame) -> DataFrame:
    """(key, turn, role, digest, initial, fault, n): distinct turns and how often
    they come. Only the first of equal ones can be without a fault."""
    end = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kinds = {
        "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
        "fault": F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("."),
    }
    order = F.struct("turn")  # a null comes first
    facts = staged(turns.withColumns(kinds).groupBy("key", "turn", "role", "digest", "initial", "fault").agg(F.count("*").alias("n")), "facts")
    first = facts.groupBy("key", "role", "digest").agg(F.min(order).alias("first"))
    again = order != F.col("first")
    known = facts.join(first, ["key", "role", "digest"])
    return known.withColumn("fault", F.when(again & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))).drop("first")


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted turns to pieces, numbered in their order."""
    number = TaskContext.get().partitionId() << 32
    key, held = None, []

    def piece() -> dict:
        nonlocal number
        number += 1
        turns = [{c: r[c] for c in ("turn", "role", "digest")} for r, _ in held]
        return {"key": key, "piece": number, "initials": "".join(r["initial"] for r, _ in held), "faults": "".join(f for _, f in held), "turns": turns}

    for row in rows:
        if held and row["key"] != key:
            yield piece()
            held = []
        key = row["key"]
        for nth in range(row["n"]):
            held.append((row, row["fault"] if nth == 0 or row["fault"] == "b" else "d"))
            if len(held) == PIECE:
                yield piece()
                held = []
    if held:
        yield piece()


def _answers(rows: Iterator[dict]) -> Iterator[dict]:
    """Pieces of a conversation from the last to the first: the answer from each
    state that the piece may begin in, given what each state at its end costs."""
    row, key, ends = next(rows, None), None, ENDS
    while row:
        after = next(rows, None)
        last, first = row["key"] != key, after is None or after["key"] != row["key"]
        key = row["key"]
        turns = [i + f for i, f in zip(row["initials"], row["faults"], strict=True)]
        found = [search(turns, state, ENDS if last else ends) for state in ((START,) if first else range(len(ENDS)))]
        costs, audits, exits = map(list, zip(*found, strict=True))
        ends = tuple(costs)
        yield row | {"first": first, "last": last, "costs": costs, "audits": audits, "exits": exits}
        row = after


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """Pieces from the first to the last: turns that stay, with the roles of the
    turns inserted before them, and at the end of a conversation a row with
    those left over and what was found. Turns come in order, so that the least,
    the greatest and the number of distinct ones need no list of them."""
    for row in rows:
        if row["first"]:
            state, before, audit, initial, least, latest, distinct = START, [], [], "", None, None, 0
            found = dict.fromkeys(_NUMBERS, 0) | {"cost": row["costs"][0]}
        for t in row["turns"]:
            if t["turn"] is not None and t["turn"] != latest:
                least, latest, distinct = t["turn"] if least is None else least, t["turn"], distinct + 1
        for name, fault in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            found[name] += row["faults"].count(fault)
        letters = initial + row["initials"]
        found["illegal"] += sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        initial = letters[-1]
        done, exit_state = row["audits"][state], row["exits"][state]
        if row["last"]:
            done += TAILS[exit_state]
        audit.append(done)
        turns = iter(row["turns"])
        for letter in done:
            if letter == "I":
                state = FITTING[state]
                before.append(ROLES[state])
                continue
            turn = next(turns)
            if letter == "D":
                continue
            state = FITTING[state] if letter == "R" else KEPT[state, turn["role"][0]]
            yield {"key": row["key"], "tail": False, **turn, "new_role": ROLES[state] if letter == "R" else None, "before": before}
            before = []
        if row["last"]:
            found["gaps"] = latest - least + 1 - distinct if distinct else 0
            yield {"key": row["key"], "tail": True, "before": before, "found": found | {"audit": "".join(audit)}}


def repair_plan(turns: DataFrame) -> DataFrame:
    """(key, tail, turn, role, digest, new_role, before, found): see `_chosen`."""
    facts = staged(_facts(turns), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = facts.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    pieces = staged(_streamed(ranged, _cut, _PIECES), "pieces")
    paths = staged(_streamed(_by_key(pieces, F.col("piece").desc()), _answers, _PATHS), "paths")
    return staged(_streamed(_by_key(paths, F.col("piece")), _chosen, _EDITS), "edits")


def _written(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits, each before the turns it is for, to the repaired turns."""
    key, place, edit = None, 0, None
    for row in rows:
        if row["key"] != key:
            key, place, edit = row["key"], 0, None
        if row["before"] is not None:  # an edit
            for role in row["before"]:
                yield {"key": key, "place": place, "edit": "I", "turn": None, "role": role, "text": ""}
                place += 1
            edit = None if row["tail"] else row
        elif edit and (row["turn"], row["role"], row["digest"]) == (edit["turn"], edit["role"], edit["digest"]):
            yield {"key": key, "place": place, "edit": "R" if edit["new_role"] else "K", "turn": row["turn"], "role": edit["new_role"] or row["role"], "text": row["text"]}
            place, edit = place + 1, None


def _repaired(turns: DataFrame, plan: DataFrame) -> DataFrame:
    texts = turns.withColumns({"tail": F.lit(False), "is_text": F.lit(True)})
    edits = plan.drop("found").withColumn("is_text", F.lit(False))
    both = texts.unionByName(edits, allowMissingColumns=True)
    order = ["tail", F.col("turn").asc_nulls_first(), "role", "digest", "is_text"]
    return _streamed(_by_key(both, *order), _written, _REPAIRED)


def _conversation(key: str = "key") -> Column:
    return F.nullif(F.col(key), F.lit("")).cast("long").alias("conv_id")


def repaired_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of every conversation
    after its cheapest repair. edit is K for a turn that was kept, R for one that
    was given another role and I for an inserted one, which has no text and no
    turn number. Each conversation lies in one partition, in order of `place`."""
    turns = _turns(conversations, conv, turn, role, text)
    return _repaired(turns, repair_plan(turns)).select(_conversation(), "place", "edit", "turn", "role", "text")


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    key, state = None, None
    for row in rows:
        if row["key"] != key:
            if state:
                yield {"key": key, "repaired_sha256": state.hexdigest()}
            key, state = row["key"], hashlib.sha256()
        if row["place"]:
            state.update(b"\n")
        state.update(f"{row['role']}:{row['text']}".encode())
    if state:
        yield {"key": key, "repaired_sha256": state.hexdigest()}


def conversation_audits(conversations: DataFrame, all_ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row per conversation, and per id of `all_ids`, whose
    conversations may have no rows.

    Turns come by number (nulls first), then role and digest of the text. A turn
    is blank if it is empty but for white space, else a duplicate if its role and
    text came before in the conversation, else truncated if it does not end with
    `.`, `!` or `?`; each has at most one of these faults. Null roles and texts
    count as one space. gaps are turn numbers that are missing between the least
    and the greatest; illegal counts neighbours whose initials are not su, ua or
    au.

    The repair gives initials that read `(s?(ua)+)?`: keeping a turn costs 0 (1
    if truncated), giving it the role user or assistant 2 more, deleting it 3,
    inserting an empty turn of these roles 2. Blank and duplicate turns must be
    deleted. audit is the letters (D, I, K, R) of the cheapest repair, the least
    by ASCII; the hash is that of its turns as `role:text` lines. Conversations
    without rows have zeros, no letters and the hash of nothing. Rows without a
    conversation are one conversation without an id; repeated rows are
    duplicates; an empty table gives an empty result; other columns are not
    looked at.

    A conversation with very many turns is cut into pieces; only the hash, which
    is one over its whole text, runs through it in one task, turn by turn.
    """
    turns = _turns(conversations, conv, turn, role, text)
    plan = repair_plan(turns)
    found = plan.where("tail").select("key", "found.*")
    hashes = _streamed(_repaired(turns, plan), _hashed, pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))
    ids = conversations.select(F.col(conv).alias("id"))
    if all_ids is not None:
        ids = ids.union(all_ids.select(F.col(conv)))
    keys = ids.select(F.coalesce(F.col("id").cast("long").cast("string"), F.lit("")).alias("key")).distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NUMBERS]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        keys.join(found, "key", "left")
        .join(hashes, "key", "left")
        .select(_conversation(), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    )
