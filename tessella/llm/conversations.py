"""Conversation repair by weighted finite-state composition.

Three machines are composed as the search asks for their arcs. The input acceptor reads a
conversation's rows in order. The edit transducer keeps, reroles, deletes or inserts, each
at a cost and with a label. The grammar acceptor admits the role initials (s?(ua)+)?. A
state of the composition is a row, a grammar state and the number of insertions made since
the last row (two reach whatever insertions can reach, so there are no cycles). Weights are
pairs of cost and label string, ordered by cost and then by string. The shortest path is
found in reverse topological order: a state has at most one arc for each label, so the least
(cost, label) is the first step of the least string.

Rows are dealt out by range, so a long conversation lies in several tasks. A run, its rows in
one range, becomes the weights of the best paths from every grammar state to every other;
runs are then chained in order, like matrices, and each gets its part of the labels back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, small, staged

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INSERTIONS = 2
#: The grammar acceptor: from each state, the role initials that lead to another.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", "sound"
#: Characters of role and text by which rows of one turn are dealt out to tasks.
ROLE_KEY, TEXT_KEY = 64, 32
NEVER = float("inf")


def steps(initial: str, fault: str, state: int) -> Iterator[tuple[int, str, int]]:
    """The composition's arcs that read a row: cost, label, next grammar state."""
    yield DELETE, "D", state
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if initial in GRAMMAR[state]:
            yield more, "K", GRAMMAR[state][initial]
        for role in ROLES:
            if role in GRAMMAR[state]:
                yield REROLE + more, "R", GRAMMAR[state][role]


def insertions(state: int) -> Iterator[tuple[int, str, int]]:
    """Its arcs that read nothing."""
    for role in ROLES:
        if role in GRAMMAR[state]:
            yield INSERT, "I", GRAMMAR[state][role]


@lru_cache(65536)
def layer(after: tuple[float, ...], initial: str, fault: str) -> tuple[tuple[tuple[float, str, int], ...], ...]:
    """The best (cost to go, label, next state) before a row, by insertions still allowed and grammar state; ``after`` is the cost to go behind it."""
    out: list[tuple] = []
    for allowed in range(INSERTIONS + 1):
        found = ([(cost + after[to], label, to) for cost, label, to in steps(initial, fault, q)] for q in GRAMMAR)
        more = ([(cost + out[-1][to][0], label, to) for cost, label, to in insertions(q)] if allowed else [] for q in GRAMMAR)
        out.append(tuple(min(a + b) for a, b in zip(found, more)))
    return tuple(out)


def paths(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """The best path of rows (initial, fault) between any two grammar states that have one: start, end, cost, labels."""
    found = []
    for end in GRAMMAR:
        after, spent, layers = tuple(0.0 if q == end else NEVER for q in GRAMMAR), 0.0, []
        for initial, fault in reversed(rows):
            layers.append(layer(after, initial, fault))
            after = tuple(x[0] for x in layers[-1][INSERTIONS])
            least = min(after)  # costs relative to the least are few, so that layers come from the cache
            spent, after = spent + least, tuple(c - least for c in after)
        for start in GRAMMAR:
            if after[start] < NEVER:
                q, labels = start, []
                for at in reversed(layers):
                    allowed, label = INSERTIONS, "I"
                    while label == "I":
                        _, label, q = at[allowed][q]
                        labels.append(label)
                        allowed -= 1
                found.append((start, end, int(spent + after[start]), "".join(labels)))
    return found


def ending(state: int) -> tuple[int, str]:
    """What is inserted after the last row: cost and labels."""
    if state in FINAL:
        return 0, ""
    cost, label, to = min(insertions(state))
    more = ending(to)
    return cost + more[0], label + more[1]


def chained(runs: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cost and labels of a conversation from the paths of its runs, in order."""
    best = {START: (0, "")}
    for run in runs:
        to: dict[int, tuple[int, str]] = {}
        for start, end, cost, labels in run:
            if start in best:
                way = (best[start][0] + cost, best[start][1] + labels)
                to[end] = min(to.get(end, way), way)
        best = to
    return min((cost + ending(q)[0], labels + ending(q)[1]) for q, (cost, labels) in best.items())


def applied(labels: str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """The rows (role, text) that labels make of the given ones: role, text, label. ``state`` is the grammar state before them."""
    for label in labels:
        role, text = ("", "") if label == "I" else next(rows)
        if label == "D":
            continue
        initial = role[:1] if label == "K" else next(r for r in ROLES if r in GRAMMAR[state])
        state = GRAMMAR[state][initial]
        yield role if label == "K" else ROLES[initial], text, label


def state_after(labels: str, initials: list[str], state: int) -> int:
    rows = iter([(i, "") for i in initials])
    for role, _, _ in applied(labels, rows, state):
        state = GRAMMAR[state][role[:1]]
    return state


PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
COUNTS = ("n", BLANK, DUPLICATE, CUT, "illegal", "turns", "first_turn", "last_turn")
RUN_SQL = "part long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, initials string, paths array<struct<start:int,end:int,cost:long,labels:string>>"


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows with equal first columns: the key and the rest of each row, as they come."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(rows, None)

    def rest(key: tuple) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[:keys] == key:
            row, ahead = ahead, next(rows, None)
            yield row[keys:]

    while ahead is not None:
        key = ahead[:keys]
        group = rest(key)
        yield key, group
        for _ in group:
            pass


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size`` rows, or of some ``most`` characters of text."""
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or length >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def run_of(rows: Iterator[tuple]) -> tuple:
    """What a run's rows (turn, initial, fault, copies) amount to."""
    read_rows, turns = [], []
    for turn, initial, fault, copies in rows:
        if fault is not None:
            read_rows += [(initial, fault)] + [(initial, BLANK if fault == BLANK else DUPLICATE)] * (copies - 1)
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
    faults, initials = [f for _, f in read_rows], [i for i, _ in read_rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    found = [dict(zip(("start", "end", "cost", "labels"), p)) for p in paths(read_rows)]
    ends = [turns[0], turns[-1]] if turns else [None, None]
    return len(read_rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, len(turns), *ends, "".join(initials), found


def whole_of(runs: list[dict]) -> tuple:
    """A conversation's counts, cost and audit, and each run's part of it: part, start state, rows before, labels."""
    runs = [r for r in runs if r["n"]]
    total = {c: sum(r[c] for r in runs) for c in COUNTS[:6]}
    total["illegal"] += sum(a["initials"][-1] + b["initials"][0] not in LEGAL for a, b in zip(runs, runs[1:]))
    timed = [r for r in runs if r["turns"]]
    total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - total["turns"] if timed else 0
    cost, audit = chained([[(p["start"], p["end"], p["cost"], p["labels"]) for p in r["paths"]] for r in runs])
    slices, at, state, before = [], 0, START, 0
    for k, r in enumerate(runs):
        end, seen = at, 0
        while seen < r["n"]:
            seen += audit[end] != "I"
            end += 1
        labels = audit[at:] if k == len(runs) - 1 else audit[at:end]
        slices.append({"part": r["part"], "state": state, "before": before, "labels": labels})
        state, at, before = state_after(labels, r["initials"], state), end, before + len(labels) - labels.count("D")
    return gaps, *(total[c] for c in (BLANK, DUPLICATE, CUT, "illegal")), cost, audit, slices


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row for each conversation, and the rows of the repaired ones.

    Conversations: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows:
    conv_col, position (from 0), role, text, edit (K, R or I).

    Rows are read by turn, null turns first; rows of one turn by role, then text; a null role or
    text counts as one space, a null conversation is one like any other. An empty role has no
    place in the grammar. Turns are whole
    numbers. A row is blank without anything but white space, else a duplicate if role and text
    stand in an earlier row, else truncated if it doesn't end in one of ``.!?``. Where
    ``gone_col`` is true, a row only tells that its conversation exists; one without other rows
    has counts and cost 0 and an empty audit. No rows give no conversations; other columns
    are ignored.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    gone = F.col(gone_col) if gone_col else F.lit(False)
    said = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = conversations.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.when(~gone, F.col(turn_col).cast("long")).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), gone.alias("gone"))
    # Equal rows of a turn are counted where they lie, so that no number of them meets in a task.
    rows = rows.groupBy("conv", "turn", "role", "text", "gone").agg(F.count("*").cast("int").alias("copies"))
    content = {"g": F.xxhash64("role", "text"), "h": F.xxhash64(F.lit(1), "text", "role")}
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = staged(rows.withColumns(content), "conversation_rows")
    begun = rows.where("not gone").groupBy("conv", *content).agg(F.min(when).alias("begun"), F.count("*").alias("holders")).where("holders > 1").drop("holders")
    rows = rows.join(small(staged(begun, "repeated")), ["conv", *content], "left")
    fault = F.when(F.col("text").rlike(r"\A[\x20\x09-\x0D]*\z"), BLANK).when(when > F.col("begun"), DUPLICATE).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SOUND).otherwise(CUT)
    rows = rows.withColumn("fault", F.when(~F.col("gone"), fault))
    order = [F.col("conv.id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    head = F.when(F.length("role") <= ROLE_KEY, F.substring("text", 1, TEXT_KEY))
    rows = rows.repartitionByRange(*order, F.substring("role", 1, ROLE_KEY), head).sortWithinPartitions(*order, "role", "text")
    rows = staged(rows.select("conv", "turn", "role", "text", "fault", "copies", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "dealt")

    conv = rows.select("conv").limit(0).toArrow().schema.field("conv").type
    run_schema = pa.schema([("conv", conv), ("part", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("initials", pa.string()), ("paths", pa.list_(PATH))])
    initial = F.when(F.col("role") == "", "\0").otherwise(F.substring("role", 1, 1))  # always one character
    own = rows.select("conv", "part", "turn", initial.alias("initial"), "fault", "copies", "at").repartition("conv", "part").sortWithinPartitions("conv", "part", "at").drop("at")
    runs = map_batches(own, lambda batches: in_batches(((*key, *run_of(group)) for key, group in grouped(batches, 2)), run_schema), f"conv struct<id:{kind}>, {RUN_SQL}")
    gathered = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *(c for c in COUNTS), "initials", "paths"))).alias("runs"))
    slice_type = pa.struct([("part", pa.int64()), ("state", pa.int32()), ("before", pa.int64()), ("labels", pa.string())])
    whole_schema = pa.schema([("conv", conv), *((c, pa.int64()) for c in ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")), ("audit", pa.string()), ("slices", pa.list_(slice_type))])
    sql = f"conv struct<id:{kind}>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, slices array<struct<part:long,state:int,before:long,labels:string>>"
    wholes = staged(map_batches(gathered, lambda batches: in_batches(((*key, *whole_of(next(group)[0])) for key, group in grouped(batches, 1)), whole_schema), sql), "repairs")

    # Each run's labels stand before its rows.
    heads = wholes.select("conv", F.explode("slices").alias("s")).select("conv", "s.part", F.lit(-1).cast("long").alias("at"), F.col("s.labels").alias("role"), F.lit("").alias("text"), F.lit(1).alias("copies"), "s.state", "s.before")
    body = rows.where("fault is not null").select("conv", "part", "at", "role", "text", "copies", F.lit(None).cast("int").alias("state"), F.lit(None).cast("long").alias("before"))
    laid = heads.unionByName(body).repartition("conv", "part").sortWithinPartitions("conv", "part", "at").drop("at")
    turn_schema = pa.schema([("conv", conv), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (of, _), group in grouped(batches, 2):
            labels, _, _, state, before = next(group)
            each = ((role, text) for role, text, copies, _, _ in group for _ in range(copies))
            for k, (role, text, edit) in enumerate(applied(labels, each, state)):
                yield of, before + k, role, text, edit

    out = map_batches(laid, lambda batches: in_batches(turns(batches), turn_schema), f"conv struct<id:{kind}>, position long, role string, text string, edit string")
    return wholes.select(F.col("conv.id").alias(conv_col), "gaps", BLANK, DUPLICATE, CUT, "illegal", "cost", "audit"), out.select(F.col("conv.id").alias(conv_col), "position", "role", "text", "edit")


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The SHA-256 of each conversation's ``role:text`` lines: conv_col, repaired_sha256. One task hashes a conversation, as its text passes by."""
    kind = turns.schema[conv_col].dataType.simpleString()
    lines = turns.select(F.col(conv_col).alias("id"), F.concat("role", F.lit(":"), "text").alias("line"), "position")
    lines = lines.repartition("id").sortWithinPartitions("id", "position").drop("position")
    schema = pa.schema([("id", lines.limit(0).toArrow().schema.field("id").type), ("sha", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (of,), group in grouped(batches, 1):
            digest, mark = hashlib.sha256(), b""
            for (line,) in group:
                digest.update(mark + line.encode())
                mark = b"\n"
            yield of, digest.hexdigest()

    return map_batches(lines, lambda batches: in_batches(hashed(batches), schema), f"id {kind}, sha string").select(F.col("id").alias(conv_col), F.col("sha").alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: gone, emptied, without full stops, repeated, or said by the user. Nulls become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), how.alias("how"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("how") == 0).alias("gone"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation's counts, cheapest audit, its cost and the digest of what it repairs to."""
    found, turns = repaired(damaged(read(spark, sf_dir, "conversations")), gone_col="gone")
    shas = digests(turns)
    out = found.join(shas.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
