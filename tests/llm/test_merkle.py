"""The Merkle manifest against trees built in one list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from acrely.llm import merkle
from acrely.llm.common import ascii_lower


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        out.append((nodes[first:i], nodes[i + 1:first + 8]))
        i //= 8
    return out


def plain(rows, changed=lambda r: None):
    """Sorted (leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars)."""
    digest = lambda r, text: leaf([r[0], r[3], r[2], r[4], text])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        built[g] = tree([digest(r, r[1]) for r in groups[g]])
    top = tree([built[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = steps(built[g], i) + steps(top, at)
            text = changed(r)
            folded = digest(r, r[1] if text is None else text)
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            out.append((built[g][0][i], built[g][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), folded))
    return sorted(out)


def proven(manifest, **how):
    rows = merkle.prove(manifest, **how).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows)


def full(rows):
    return [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize("leaf_rows", [100_000, 7])
def test_odd_rows(frame, odd_rows, leaf_rows, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF_ROWS", leaf_rows)
    found = proven(merkle.build(frame(odd_rows), later=F.when(F.col("doc_id") % 2 == 0, merkle.leaf_hash(
        [*[F.col(c) for c in merkle.FIELDS[:-1]], ascii_lower(F.col("text"))]))))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert found == plain(full(odd_rows), lambda r: r[1].translate(lower) if r[1] is not None and r[0] is not None and r[0] % 2 == 0 else None)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9], [64, 65], [1, 7, 63, 520], [2] * 70])
def test_sizes(frame, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF_ROWS", 40)
    rows = [(i, f"text {i} {g}", f"g{g:03}", "s") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    manifest = merkle.build(frame(rows, clashing=False))
    assert proven(manifest) == plain(full(rows))


def test_requests_are_minimal(frame, monkeypatch):
    """A partition asks for what lies outside it in its first and last run on each level, and for nothing twice."""
    monkeypatch.setattr(merkle, "LEAF_ROWS", 50)
    manifest = merkle.build(frame([(i, f"t{i}", "en", "s") for i in range(700)], clashing=False))
    asked = merkle._requests(manifest.segments).collect()
    assert len({tuple(r) for r in asked}) == len(asked)
    segments = {r["pid"]: r for r in manifest.segments.collect()}
    assert len(segments) > 4
    for pid, s in segments.items():
        want, touched = set(), set(range(s["low"], s["low"] + s["size"]))
        for level, width in enumerate(merkle.widths(700)[:-1]):
            run = {i for t in touched for i in range(t // 8 * 8, min(t // 8 * 8 + 8, width))}
            want |= {(level, i) for i in run - touched}
            touched = {t // 8 for t in touched}
        assert {(r["level"], r["idx"]) for r in asked if r["pid"] == pid and r["tree"] >= 0} == want
    # Shared nodes are few beside the leaves; a fetched coordinate is always among them.
    nodes = {(r["tree"], r["level"], r["idx"]) for r in manifest.nodes.collect()}
    assert {(r["tree"], r["level"], r["idx"]) for r in asked} <= nodes


def test_steps_fold_to_the_root(frame):
    rows = merkle.prove(merkle.build(frame([(i, f"t{i}", "ab"[i % 2], "s") for i in range(100)])), steps_too=True).collect()
    assert all(merkle.fold(r["leaf"], [tuple(s) for s in r["proof"]]) == r["root"] for r in rows)


def test_text_identifiers_nulls_and_none(spark, frame):
    assert merkle.prove(merkle.build(frame([]))).count() == 0
    docs = spark.createDataFrame([("b", None, None, None, None), ("a", "x", None, None, 1)], "doc_id string, text string, lang string, source string, n_chars long")
    found = merkle.prove(merkle.build(docs)).collect()
    assert sorted(r["key"] for r in found) == ["a", "b"] and all(r["verified"] for r in found)
    big = (1 << 60) + 1
    kept = merkle.prove(merkle.build(frame([(big, "x", "en", "s"), (None, "y", "en", "s")]))).collect()
    assert {r["key"] for r in kept} == {big, None}
