import random
import zlib

import pytest
from pyspark.sql import functions as F

from acrely.llm import kd_shards
from tests.llm.conftest import prose


def check(rows, shards):
    sizes, slots = {}, {}
    for r in rows:
        sizes[r._shard.shard] = sizes.get(r._shard.shard, 0) + r._shard.size
        slots.setdefault(r._shard.shard, []).append(r._shard.slot)
    assert set(sizes) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(1, 60)), rng.choice(("aa", "bb", None)), rng.choice(("s1", "s2", "s3"))) for i in range(n)]


def test_shards_hold_about_the_same_bytes(frame, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 16)
    docs = frame(corpus(1, 2000))
    rows = kd_shards.kd_shards(docs, shards=11).collect()
    sizes = check(rows, 11)
    mean = sum(sizes.values()) / 11
    assert len(rows) == 2000 and len(sizes) == 11
    assert all(abs(x - mean) < 600 for x in sizes.values())  # a few rows, of 300 bytes each
    for r in rows[:50]:
        assert r._shard.size == len(r.text.encode()) + 16 and r._shard.crc32 == zlib.crc32(r.text.encode())


def test_a_shard_is_a_box(frame):
    """Rows of a shard lie in one range of every dimension that the tree was split by."""
    docs = frame(corpus(2, 600))
    rows = kd_shards.kd_shards(docs, dims=("n_chars",), shards=4).collect()
    ranges = {}
    for r in rows:
        lo, hi = ranges.get(r._shard.shard, (r.n_chars, r.n_chars))
        ranges[r._shard.shard] = min(lo, r.n_chars), max(hi, r.n_chars)
    ordered = [ranges[k] for k in sorted(ranges)]
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_equal_metadata_is_split_by_the_hash(frame):
    rows = kd_shards.kd_shards(frame([(i, "same text", "xx", "s") for i in range(400)]), dims=("lang", "source", "n_chars"), shards=8).collect()
    assert set(check(rows, 8).values()) == {50 * 25}


def test_rows_or_partitions_do_not_matter(frame):
    docs = frame(corpus(3, 300))
    pick = lambda df: sorted((r.doc_id, r._shard.shard, r._shard.slot) for r in kd_shards.kd_shards(df, shards=5).collect())
    assert pick(docs) == pick(docs.repartition(6))


def test_target_bytes(frame):
    docs = frame(corpus(4, 500))
    total = sum(len(r.text) + 16 for r in docs.collect())
    rows = kd_shards.kd_shards(docs, target_bytes=total // 6).collect()
    assert len(check(rows, 7)) == 7


def test_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    found = kd_shards.kd_shards(docs, shards=3)
    assert found.columns == [*[c for c in docs.columns if c != "_shard"], "_shard"]
    rows = found.collect()
    check(rows, 3)
    assert len(rows) == len(odd_rows)
    assert {(r._shard.size, r._shard.crc32) for r in rows if r.text is None} == {(16, 0)}


def test_empty_table_and_more_shards_than_rows(frame):
    assert kd_shards.kd_shards(frame([])).count() == 0
    rows = kd_shards.kd_shards(frame([(1, "a"), (2, "b")]), shards=40).collect()
    check(rows, 40)
    assert len({r._shard.shard for r in rows}) == 2


# ---- against a plain tree, and dimensions of every kind --------------------------

def plain_shards(rows, dims, shards):
    """rows: (size, keys, tie). The same splits by sorting: halves at the weighted quantile of the widest dimension."""
    spans = [max(1, max(r[1][i] for r in rows) - min(r[1][i] for r in rows)) for i in range(dims)]
    out = {}

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update({r[2]: first for r in part})
            return
        widths = [((max(r[1][i] for r in part) - min(r[1][i] for r in part)) / spans[i], -i) for i in range(dims)]
        width, dim = max(widths)
        order = sorted(part, key=lambda r: ((r[1][-dim],) if width > 0 else ()) + (r[2],))
        target, below, at = sum(r[0] for r in part) * (leaves // 2) / leaves, 0, 0
        while at < len(order) - 1 and below + order[at][0] < target:
            below, at = below + order[at][0], at + 1
        cut = at + 1 if below + order[at][0] / 2 <= target else at
        split(order[:cut], first, leaves // 2)
        split(order[cut:], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


def test_equals_a_plain_tree(frame):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 200)), rng.choice(["aa", "bb", "cc"]), rng.choice(["s1", "s2", None])) for i in range(400)]
    docs = frame(rows)
    dims = ("lang", "source", "n_chars", "doc_id")
    for shards in (2, 7, 40):
        keyed = kd_shards.keyed(docs, dims).selectExpr("size", "array(k0, k1, k2, k3) AS keys", "tie", "id").collect()
        want = plain_shards([(r["size"], r["keys"], r["tie"]) for r in keyed], 4, shards)
        found = kd_shards.kd_shards(docs, dims, shards).selectExpr("doc_id", "_shard.shard AS shard").collect()
        ties = {r["id"]: r["tie"] for r in keyed}
        assert {r.doc_id: r.shard for r in found} == {i: want[t] for i, t in ties.items()}


def test_keys_rise_with_values_of_every_kind(spark):
    big = [float("-inf"), -1e300, -2.5, -1.0, -0.3, -1e-300, 0.0, 5e-324, 1e-300, 0.1, 0.25, 0.3, 1.0, 1.5, 2.0, 3.75, 1e300, float("inf")]
    for kind, values in (("double", big), ("float", [-2.0, -0.5, 0.0, 0.25, 8.0]), ("decimal(10,3)", ["-1.5", "0", "0.001", "2"]),
                         ("date", ["1960-01-01", "1970-01-01", "2024-02-29"]), ("timestamp", ["1960-01-01 00:00:00", "2024-01-01 00:00:00.5"]),
                         ("string", ["", "a", "ab", "b", "é"]), ("boolean", ["false", "true"]), ("long", [-5, 0, 7])):
        df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string").withColumn("v", F.col("v").cast(kind))
        keys = [r.k for r in df.select("i", kd_shards._key(df, "v").alias("k")).orderBy("i").collect()]
        assert keys == sorted(set(keys)), kind


def test_dimensions_of_every_kind_are_split(frame):
    rng = random.Random(2)
    docs = frame([(i, prose(rng, 30), "en", "s") for i in range(200)]).withColumns({
        "share": F.col("doc_id") / 500, "odd": F.when(F.col("doc_id") % 7 == 0, float("nan")).when(F.col("doc_id") % 7 == 1, None).otherwise(F.col("doc_id") / 3),
        "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")), "_shard": F.lit(1), "_node": F.lit(2), "_row": F.lit(3)})
    for dim in ("share", "odd", "day"):
        found = kd_shards.kd_shards(docs, (dim,), 4)
        rows = found.select("doc_id", dim, "_shard.*").collect()
        assert sorted({r["shard"] for r in rows}) == [0, 1, 2, 3] and len(rows) == 200
        if dim != "odd":  # shards are ranges of the dimension, not a hash
            ends = [(min(r[dim] for r in rows if r["shard"] == k), max(r[dim] for r in rows if r["shard"] == k)) for k in range(4)]
            assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    again = kd_shards.kd_shards(kd_shards.kd_shards(docs, shards=3), shards=3)
    assert again.columns.count("_shard") == 1 and again.count() == 200
    with pytest.raises(ValueError, match="no order"):
        kd_shards.kd_shards(docs.withColumn("list", F.array("doc_id")), ("list",), 2)
