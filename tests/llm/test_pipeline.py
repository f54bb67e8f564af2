"""The stages of the pipeline against brute-force versions of their decisions."""

import random
import zlib

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard_join, test_mixing
from tests.llm.test_classifiers import SYLLABLES, speak


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("corpus"))
    items = [(i, speak(rng, "aa", 14)) for i in range(5)]
    rows = []
    for lang in ("aa", "bb", "cc"):
        for _ in range(70):
            rows.append((speak(rng, lang, rng.randint(8, 60)), lang))
    for _ in range(20):
        text, lang = rng.choice(rows)
        words = text.split()
        if len(words) > 30:
            words[-1] = "changed"
        rows.append((" ".join(words), lang))
    rows += [(speak(rng, "bb", 30) + " " + rng.choice(items)[1], "bb") for _ in range(8)]
    rows += [(speak(rng, "bb", 600) + " " + items[0][1], "bb"), ("12 34 !!", "aa"), (None, "aa"), ("", None)]
    rng.shuffle(rows)
    table = [(i, t, lang, rng.choice(("s1", "s2", "s3", None)), None if t is None else len(t)) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, table, items


def test_stages(spark, folder, tmp_path):
    path, table, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, alive, kept = docs.columns, {r[0]: r for r in table}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = [r.doc_id for r in docs.collect()]
        if name != "shard":
            assert docs.columns == names
            for r in docs.collect():
                assert tuple(r) == alive[r.doc_id]

    lettered = {i for i, r in alive.items() if any(c.isalpha() for c in r[1] or "")}
    assert sorted(kept["identify language"]) == sorted(lettered)

    rows = [(i, alive[i][1]) for i in sorted(lettered)]
    survivors = sorted(d for d, _, c in test_jaccard_join.brute(rows) if d == c)
    assert sorted(kept["near duplicates"]) == survivors and len(survivors) < len(lettered)

    clean = []
    for i in survivors:
        n, hit, _ = test_decontaminate.brute(alive[i][1], items, 13)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    assert sorted(kept["decontaminate"]) == clean and len(survivors) - len(clean) >= 8

    sizes, taken = {}, {}
    for i in clean:
        sizes[alive[i][3]] = sizes.get(alive[i][3], 0) + len(alive[i][1].split())
    for i in kept["mix"]:
        taken[alive[i][3]] = taken.get(alive[i][3], 0) + len(alive[i][1].split())
    for source, target in test_mixing.brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 12
    assert all(kept["mix"].count(i) <= 3 for i in clean)

    assert sorted(kept["shard"]) == sorted(kept["mix"])
    slots = {}
    for r in docs.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_writes_every_stage_and_keeps_the_last(spark, folder):
    path, table, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 100
    assert {zlib.crc32((r.text or "").encode()) for r in out.collect()} <= {zlib.crc32((t or "").encode()) for _, t, *_ in table}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
