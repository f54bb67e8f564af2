import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from acrely.llm import exact_dedup


def stored(df, path, files=1):
    df.repartition(files).write.parquet(str(path))
    return str(path)


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c.lower() if c.isascii() else c for c in (r[1] or ""))].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()), key=repr)


def test_odd_rows_over_several_batches(spark, frame, odd_rows, tmp_path):
    path = stored(frame(odd_rows), tmp_path / "docs.parquet", 4)
    assert got(exact_dedup.exact_dedup(spark, path, batch_bytes=1)) == expected(odd_rows)


def test_a_hot_text(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPLIT_ROWS", 20)
    rows = [(i, "the same" if i % 3 else f"text {i}") for i in range(300)]
    path = stored(frame(rows), tmp_path / "docs.parquet", 3)
    assert got(exact_dedup.exact_dedup(spark, path)) == expected(rows)


def test_digests_that_collide_are_told_apart_by_their_bytes(spark, frame, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    path = stored(frame(rows), tmp_path / "docs.parquet")
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path, digest=weak).collect())
    assert found == sorted(x[:4] for x in expected(rows))


def test_a_restarted_job_goes_on(spark, frame, tmp_path):
    path = stored(frame([(1, "a"), (2, "A")]), tmp_path / "docs.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        exact_dedup.keep_state(exact_dedup.follow(spark, path), out, state).awaitTermination()
        frame([(3, "a"), (4, "b")]).write.mode("append").parquet(path)
    rows = {r.text_sha256: (r.group_size, r.keep_id) for r in exact_dedup.read_state(spark, out).collect()}
    assert sorted(rows.values()) == [(1, 4), (3, 3)]


def test_empty_table(spark, frame, tmp_path):
    assert exact_dedup.exact_dedup(spark, stored(frame([]), tmp_path / "docs.parquet")).count() == 0
