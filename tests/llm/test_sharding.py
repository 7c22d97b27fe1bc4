"""The assignment to shards, recomputed row by row."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tessella.llm import sharding


def digest(data: bytes) -> int:
    return int(hashlib.md5(data).hexdigest()[:15], 16)


def plain_shards(rows, shards=16, whole=0.01):
    """(id, size, crc, shard, slot) by one sorted list and its running sums."""
    items = []
    for i, text in rows:
        data = (text or "").encode()
        items.append((digest(data), digest(("" if i is None else str(i)).encode()), i, len(data) + 1, zlib.crc32(data)))
    total, count = sum(x[3] for x in items), len(items)
    groups = {}
    for h, _, _, size, _ in items:
        b, n = groups.get(h, (0, 0))
        groups[h] = (b + size, n + 1)
    hot = {h: max(1, -(-n * 2**12 // max(count, 1))) for h, (b, n) in groups.items() if b > total * whole / shards or n > max(64, count * whole / shards)}
    place = lambda x: (x[0] >> 48, x[0] if x[0] in hot else -1, ((x[1] >> 36) * hot.get(x[0], 0)) >> 24)
    items.sort(key=lambda x: (*place(x), x[0], x[1], x[2] is not None, x[2] or 0, x[3]))
    out, at, first, slots = [], 0, {}, {}
    for x in items:
        start = at if x[0] in hot else first.setdefault((place(x), x[0]), at)
        shard = min(shards - 1, start * shards // total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((x[2], x[3], x[4], shard, slots[shard]))
        at += x[3]
    return out


def test_assignment_equals_one_sorted_list(spark):
    rows = [(i, f"text {i} " + "w" * (i * 37 % 200)) for i in range(600)] + [(1000 + i, "a text of many copies") for i in range(300)] + [(2000 + i, "few copies") for i in range(5)]
    rows += [(3000, None), (3001, ""), (3002, "long " * 20_000), (5, "repeated id"), (5, "repeated id"), (None, "no id"), (None, "text 3 ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(1), "h": F.lit("x"), "row": F.lit(2)})
    got = [tuple(r) for r in sharding.byte_shards(df).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=repr) == sorted(plain_shards(rows), key=repr)
    assert len({r[3] for r in got}) == 8  # the long text fills the other half
