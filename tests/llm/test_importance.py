"""Importance resampling against a plain version over strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from acrely.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text, longest)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = enough[:percent * len(enough) // 100]
    return sorted(map(repr, out)), [(i + 1, r[4], r[0]) for i, r in enumerate(drawn)]


@pytest.mark.parametrize("longest, buckets, percent, least", [(2, 10_000, 25, 20), (3, 97, 60, 1), (1, 5, 100, 0)])
def test_against_plain(spark, frame, odd_rows, longest, buckets, percent, least):
    target = ["One two three of the SAME kind", None, "", "É è naïve 42 words", odd_rows[6][1]]
    docs = frame(odd_rows)
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    gains = importance.fit(docs, texts, longest=longest, buckets=buckets)
    drawn = importance.resample(docs, gains, percent=percent, least_words=least)
    assert drawn.columns == [*docs.columns, "_drawn"]
    found = drawn.select("doc_id", "_drawn.*").collect()
    figures, ranks = plain([r[:2] for r in odd_rows], target, longest, buckets, percent, least)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in found) == figures
    assert sorted((r["rank"], r["score"], r["doc_id"]) for r in found if r["rank"] is not None) == ranks


def test_separators_by_the_table():
    text = "".join(map(chr, range(0x250))) + " Ünï-cödé x y 世界 a'b"
    assert [w.decode() for w in importance.words_of(text.encode())] == WORD.findall(lower(text))


def test_chained_hash_is_that_of_the_joined_run():
    words = ["grüße".encode(), b"from", b"42", b"from"]
    for n, hashes in enumerate(importance.run_hashes(words, 5), 1):
        assert hashes == [zlib.crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]


def test_counts_do_not_depend_on_when_they_are_reduced(frame, odd_rows, monkeypatch):
    docs = frame(odd_rows)
    whole = {r["bucket"]: r["n"] for r in importance.feature_counts(docs).collect()}
    monkeypatch.setattr(importance, "DISTINCT", 10)
    assert {r["bucket"]: r["n"] for r in importance.feature_counts(docs).collect()} == whole


def test_draws_lean_to_the_target(frame):
    rows = [(i, " ".join(("alpha beta gamma" if i % 4 == 0 else "delta epsilon zeta").split() * 10)) for i in range(400)]
    docs = frame(rows)
    gains = importance.fit(docs, frame([(0, "alpha beta gamma " * 50)]))
    drawn = importance.resample(docs, gains, keep=["doc_id"]).filter("_drawn.rank is not null").collect()
    assert len(drawn) == 100 and sum(r["doc_id"] % 4 == 0 for r in drawn) > 60


def test_empty_tables_and_own_output(frame):
    empty = frame([])
    gains = importance.fit(empty, empty)
    assert set(gains.table) == {0}
    assert importance.resample(empty, gains).count() == 0
    once = importance.resample(frame([(1, "a b c " * 10), (2, "d e f " * 10)]), gains, percent=50)
    again = importance.resample(once, gains, percent=50)
    assert again.columns == once.columns and sorted(again.collect()) == sorted(once.collect())
