import random
import re

from acrely.llm import decontaminate
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in (text or "")))


def brute(text, items, window):
    found, hit, named = words(text), set(), set()
    for item, body in items:
        seq = words(body)
        n = min(window, len(seq))
        for s in range(len(seq) - n + 1 if n else 0):
            for p in range(len(found) - n + 1):
                if found[p:p + n] == seq[s:s + n]:
                    hit |= set(range(p, p + n))
                    named.add(str(item))
    return len(found), len(hit), sorted(named)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice((1, 2, 3, 4, 6, 9, 14)))) for i in range(30)] + [(40, None), (41, "?!"), (42, ""), (43, "ban ban ban ban ban")]
    items += [(50, items[5][1]), (51, items[5][1] + " ban")]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            item = words(rng.choice(items)[1])
            start = rng.randint(0, max(0, len(item) - 3))
            parts += [" ".join(item[start:start + rng.randint(1, 9)]), prose(rng, rng.randint(0, 3))]
        rows.append((i, " ".join(parts)))
    return items, rows + [(90, "ban, BAN. ban-ban ban ban")]


def test_equals_brute_force(spark, frame):
    for seed, window, block in ((1, 4, 10 ** 6), (2, 5, 10 ** 6), (3, 3, 20)):
        items, rows = corpus(seed)
        found = decontaminate.annotate(frame(rows), bench(spark, items), window=window, block_words=block)
        got = {r.doc_id: (r._found.n_words, r._found.n_hit, r._found["items"]) for r in found.collect()}
        assert got == {i: brute(t, items, window) for i, t in rows}


def test_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    found = decontaminate.annotate(docs, bench(spark, [(1, "two"), (2, "é É"), (None, "one")]))
    assert found.columns == [*docs.columns, "_found"] and found.count() == len(odd_rows)
    by_id = {r.doc_id: r._found for r in found.collect()}
    assert (by_id[5].n_words, by_id[5].n_hit, sorted(by_id[5]["items"])) == (2, 2, ["", "1"])
    assert (by_id[1].n_words, by_id[1].n_hit) == (0, 0)
    assert (by_id[12].n_words, by_id[12].n_hit, [tuple(s) for s in by_id[12].spans]) == (3, 2, [(1, 2)])


def test_one_automaton_is_held_at_a_time(spark, frame, odd_rows, monkeypatch):
    items, rows = corpus(5)
    rows += odd_rows
    held, most = set(), []
    make = decontaminate._pass

    def one_pass(docs, block, *more):
        found, automaton = make(docs, block, *more)
        held.add(automaton)
        most.append(len(held))
        destroy = automaton.destroy
        automaton.destroy = lambda *a, **b: (held.discard(automaton), destroy(*a, **b))
        return found, automaton

    whole = decontaminate.annotate(frame(rows), bench(spark, items), window=4)
    monkeypatch.setattr(decontaminate, "_pass", one_pass)
    parts = decontaminate.annotate(frame(rows), bench(spark, items), window=4, block_words=15)
    assert len(most) > 3 and max(most) == 1 and not held
    assert parts.columns == whole.columns and sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    narrow = decontaminate.annotate(frame(rows), bench(spark, items), window=4, block_words=15, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "_found"] and narrow.count() == len(rows)


def test_empty_tables(spark, frame):
    assert decontaminate.annotate(frame([]), bench(spark, [(1, "a b")])).count() == 0
    found = decontaminate.annotate(frame([(1, "a b")]), bench(spark, [])).first()._found
    assert (found.n_words, found.n_hit, found["items"]) == (2, 0, [])


def test_spans_are_cut_out_and_covered_documents_go(spark, frame):
    rng = random.Random(2)
    item = " ".join(f"q{i}" for i in range(15))
    text = prose(rng, 400) + " -- " + item.upper() + "; " + prose(rng, 400)
    kept = {r.doc_id: r.text for r in decontaminate.scrub(frame([(1, text), (2, item + " x"), (3, "clean"), (4, None)]), bench(spark, [(1, item)])).collect()}
    assert kept == {1: text.replace(item.upper(), ""), 3: "clean", 4: None}
