"""Conversation repair against a plain search over whole outputs."""

import hashlib
import heapq
import itertools
import os
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_damage(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            row = (t, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
            convs[c] += [row] * (2 if how == 3 else 1)
    return convs


def plain_repair(rows):
    """Uniform-cost search by (cost, audit) over (rows read, output so far)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        if (i, out) in done or not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        done.add((i, out))
        if len(out) < len(rows) + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] in ("", "t"):
                more = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (to, text))))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r[:1] or "-" for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit), sha, [(k, r, t) for k, (r, t) in enumerate(out)]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_the_plain_search(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    want = []
    for c, left in plain_damage(rows).items():
        counts, sha, _ = plain_repair(left)
        want.append((c, *counts, sha))
    out = conversations.op13_conversations(spark, SF)
    assert sorted(map(tuple, out.select(*COLUMNS).collect())) == sorted(want)
    assert dict(out.dtypes)["cost"] == dict(out.dtypes)["gaps"] == "bigint"


def test_every_short_conversation_equals_the_plain_search(spark):
    says = [("s", "A."), ("u", "B!"), ("u", "cut"), ("a", "C? "), ("a", ""), ("tool", "D."), ("u", "B!")]
    rows, n = [], 0
    for size in range(1, 5):
        for chosen in itertools.product(says, repeat=size):
            rows += [(n, t, role, text) for t, (role, text) in enumerate(chosen)]
            n += 1
    found, turns = conversations.repaired(spark.createDataFrame(rows, ROWS))
    got, said = {r.conv_id: tuple(r)[1:] for r in found.collect()}, {}
    for r in turns.collect():
        said.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for c, group in itertools.groupby(rows, lambda r: r[0]):
        counts, _, out = plain_repair([r[1:] for r in group])
        assert got[c] == counts and sorted(said.get(c, [])) == out


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 9, "user", "Hi."), (1, 9, "user", "Hi."), (1, 4, "", "x "), (None, 1, "assistant", "Well."), (None, None, "system", "S."), (2, 3, "s" * 100 + "a", "A."), (2, 3, "s" * 100 + "b", "A."), (2, -5, "user", "\ttext.\x0b\n"), (3, 0, "user", "x" * 200_000 + "."), (3, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({"conv": F.lit(1), "at": F.lit("x"), "part": F.lit(None), "copies": F.lit(3), "gone": F.col("turn") == 99})
    found, turns = conversations.repaired(df)
    got, sha = {r.conv_id: tuple(r)[1:] for r in found.collect()}, {r.conv_id: r.repaired_sha256 for r in conversations.digests(turns).collect()}
    for c in (1, None, 2, 3):
        counts, want, out = plain_repair([(t, " " if role is None else role, " " if text is None else text) for i, t, role, text in rows if i == c])
        assert got[c] == counts and (sha[c] == want if out else c not in sha)
    found, turns = conversations.repaired(df.limit(0))
    assert found.count() == turns.count() == 0


def test_conversations_whose_rows_all_go(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (gone + 1000, 1, "user", None), (None, None, None, None)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: tuple(r) for r in conversations.op13_conversations(spark, str(tmp_path)).select(*COLUMNS).collect()}
    assert out[gone] == (gone, 0, 0, 0, 0, 0, 0, "", EMPTY)
    for c, left in plain_damage(rows).items():
        counts, sha, _ = plain_repair(left)
        assert out[c] == (c, *counts, sha)


def test_a_long_conversation_lies_in_several_runs(spark):
    says = [("user", "U{}."), ("assistant", "A{}."), ("user", "cut {}"), ("system", "S{}."), ("assistant", ""), ("user", "Same."), ("assistant", "A{}!")]
    rows = [(5, t // 2, says[t * t % 7][0], says[t * t % 7][1].format(t)) for t in range(1500)] + [(6, 0, "user", "U.")] * 40
    df = spark.createDataFrame(rows, ROWS)
    found, turns = conversations.repaired(df)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    data = sorted(((t, r, x) for c, t, r, x in rows if c == 5), key=lambda r: (r[0], r[1].encode(), r[2].encode()))
    # The plain search would take long here: the same path in one run has to do.
    seen, read = set(), []
    for _, role, text in data:
        fault = "blank" if not text else "duplicate" if (role, text) in seen else "sound" if text[-1] in ".!?" else "truncated"
        seen.add((role, text))
        read.append((role[:1], fault))
    cost, audit = conversations.chained([conversations.paths(read)])
    assert got[5][-2:] == (cost, audit) and got[5][0] == 0
    want = [(k, r, x, e) for k, (r, x, e) in enumerate(conversations.applied(audit, iter([(r, x) for _, r, x in data]), conversations.START))]
    assert sorted(tuple(r)[1:] for r in turns.where("conv_id = 5").collect()) == want
    assert got[6] == (0, 0, 39, 0, 39, 4 * 39 + 3, "K" + "D" * 39 + "I")
    cuts = [conversations.paths(read[a:b]) for a, b in ((0, 1), (1, 700), (700, 703), (703, len(read)))]
    assert conversations.chained(cuts) == (cost, audit)
