import random

from pyspark.sql import functions as F

from acrely.llm import jaccard_join
from acrely.llm.graph import components
from tests.llm.conftest import WORDS, prose


def sets(text):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """{row number: (size, component)} by comparing every pair."""
    all_sets = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(all_sets):
        for j in range(i):
            y = all_sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), names.get(find(i)), ) for i, ((d, _), s) in enumerate(zip(rows, all_sets)) if d is not None)


def got(found):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect() if r.doc_id is not None)


def corpus(seed):
    """Chains and groups of near copies, passages that many texts share, copies, short texts."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, 12)
    for _ in range(12):
        words = prose(rng, rng.randint(6, 90)).split()
        for _ in range(rng.randint(1, 9)):
            rows.append(" ".join(words))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                words = words + prose(rng, 2).split()
    rows += [passage + " " + prose(rng, rng.randint(5, 40)) for _ in range(25)]
    rows += [prose(rng, rng.randint(1, 6)) for _ in range(10)] + [rows[0].upper(), rows[3]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, frame):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        assert got(jaccard_join.near_duplicates(frame(rows))) == brute(rows)


def test_the_order_does_not_matter(frame):
    rows = corpus(4)
    assert got(jaccard_join.near_duplicates(frame(rows), sketch_bits=6)) == brute(rows)


def test_odd_rows(frame, odd_rows):
    plain = [(r[0], r[1]) for r in odd_rows]
    found = jaccard_join.near_duplicates(frame(odd_rows))
    assert found.count() == len(odd_rows)
    assert got(found) == brute(plain)


def test_one_row_of_each_component_stays(frame, odd_rows):
    docs = frame(odd_rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 9, 11, 11, 12]  # two texts share identifier 11 and are documents of their own
    assert sum(r.doc_id is None for r in rows) == 2


def test_repeated_identifiers_keep_unrelated_texts(frame):
    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    kept = jaccard_join.keep_one(frame([(11, a), (11, b), (12, c)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(11, a), (11, b), (12, c)])
    near, far = a + " more words", prose(rng, 80)
    rows = [(11, a), (11, a), (11, near), (11, far), (13, a), (14, far + " end"), (11, ""), (11, ""), (9, b), (11, b + " end")]
    found = [(r.doc_id, r.text) for r in jaccard_join.keep_one(frame(rows)).collect()]
    assert sorted(t for i, t in found if t not in (a, near)) == sorted([far, "", "", b])
    assert [i for i, t in found if t in (a, near)] == [11] and (9, b) in found
    again = jaccard_join.keep_one(jaccard_join.keep_one(frame(rows)))
    assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted(found)


def test_empty_table(frame):
    assert jaccard_join.near_duplicates(frame([])).count() == 0
    assert jaccard_join.keep_one(frame([])).count() == 0


def test_a_large_group_is_linked_without_all_pairs(spark, frame, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    verified = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, texts: (verified.append(pairs.count()), verify(pairs, texts))[1])
    assert {r.component_id for r in jaccard_join.near_duplicates(frame(rows)).collect()} == {0}
    assert sum(verified) < 2 * len(rows)


def test_large_crowds_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rng = random.Random(12)
    held = {i: (rng.randint(40, 90), 7 if rng.random() < 0.8 else i) for i in range(300)}
    rows = spark.createDataFrame([(1, i, n, 0, c, 300) for i, (n, c) in held.items()], "h long, id long, n int, pos int, component long, crowd long")
    for turn in (0, 1, None):
        groups = {}
        for r in jaccard_join._dealt(rows, turn).collect():
            groups.setdefault(r.g, []).append((r.side, r.id))
        assert max(map(len, groups.values())) < 80
        if turn is not None:
            assert sorted(i for g in groups.values() for _, i in g) == sorted(held)
            continue
        met = [frozenset((i, j)) for g in groups.values() for s, i in g for t, j in g if i < j and (s < 0 or s != t)]
        assert len(met) == len(set(met))
        fitting = {frozenset((i, j)) for i in held for j in held if i < j and held[i][1] != held[j][1]
                   and min(held[i][0], held[j][0]) * 5 >= max(held[i][0], held[j][0]) * 4}
        assert fitting <= set(met)
        assert not any(held[i][1] == 7 and held[j][1] == 7 for i, j in map(tuple, met))


def test_blocks_find_every_link(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    rows = corpus(7)
    assert got(jaccard_join.near_duplicates(frame(rows), sketch_bits=6)) == brute(rows)


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_sketch_counts_every_shingle(frame):
    docs = frame(corpus(6))
    profile = jaccard_join._profile(docs, "doc_id", "text", 12)
    sketch = jaccard_join._sketch(profile, 12)
    total = profile.agg(F.sum("n")).first()[0]
    assert sketch.sum(axis=1).tolist() == [total, total]
