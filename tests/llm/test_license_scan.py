import random

from hypothesis import given
from hypothesis import strategies as st

from acrely.llm import license_scan
from acrely.llm.decontaminate import words
from tests.llm.conftest import prose

LETTERS = st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=12)


def longest_common(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(LETTERS, LETTERS)
def test_alignments_rise_and_match(x, y):
    pairs = license_scan.align(x, y)
    assert all(x[i] == y[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(x, y) and (not pairs) == (not set(x) & set(y))


@given(st.permutations(list(range(9))), st.permutations(list(range(9))))
def test_unique_words_are_aligned_as_well_as_can_be(x, y):
    """Without repeated words the anchors alone are a longest common subsequence."""
    x, y = [b"%d" % i for i in x], [b"%d" % i for i in y]
    assert len(license_scan.align(x, y)) == longest_common(x, y)


def brute(text):
    """Templates whose words all stand in one row in the text."""
    found, out = words((text or "").encode()), set()
    for name, template in license_scan.TEMPLATES.items():
        t = words(template.encode())
        if any(found[i:i + len(t)] == t for i in range(len(found) - len(t) + 1)):
            out.add(name)
    return out


def test_planted_notices(frame):
    rng, rows = random.Random(3), []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 60))]
        for name in rng.sample(list(license_scan.TEMPLATES), rng.choice((0, 0, 1, 1, 2))):
            notice = license_scan.TEMPLATES[name]
            parts += [rng.choice((notice, notice.upper(), notice.replace(" ", "\n * "))), prose(rng, rng.randint(9, 30))]
            if rng.random() < 0.3:
                parts += [notice]
        rows.append((i, " ".join(parts)))
    for r in license_scan.scan_licenses(frame(rows)).collect():
        got = {x.license: x for x in r._scan.licenses}
        whole = {k for k, x in got.items() if x.coverage == 1.0}
        assert whole == brute(r.text)
        found = words(r.text.encode())
        assert r._scan.n_words == len(found)
        for name in whole:
            assert found[got[name].first] == words(license_scan.TEMPLATES[name].encode())[0]


def test_edited_notices(frame):
    notice = license_scan.TEMPLATES["gpl-3.0"]
    rng = random.Random(4)
    rows = [(1, prose(rng, 30) + " " + notice.replace("General", "Generall") + " " + prose(rng, 30)),
            (2, prose(rng, 30) + " " + notice.replace("the GNU", "the famous GNU") + " " + prose(rng, 30)),
            (3, " ".join(w + " " + prose(rng, 9) for w in notice.split())), (4, "all the rights are not reserved here")]
    got = {r.doc_id: [(x.license, round(x.coverage, 3)) for x in r._scan.licenses] for r in license_scan.scan_licenses(frame(rows)).collect()}
    assert got == {1: [("gpl-3.0", round(11 / 12, 3))], 2: [("gpl-3.0", 1.0)], 3: [], 4: []}


def test_stray_template_words_around_a_notice():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    text = "The parser is released under the MIT License. See the LICENSE file for the full text of the license."
    found, _ = scanner.scan(text.encode())
    assert [(x["license"], x["coverage"], x["first"], x["last"]) for x in found] == [("mit", 1.0, 3, 7)]


def test_notices_in_prose_of_the_template_words():
    rng, scanner = random.Random(6), license_scan.Scanner(license_scan.TEMPLATES)
    for name, notice in license_scan.TEMPLATES.items():
        template = words(notice.encode())
        for trial in range(20):
            strays = [[w.decode() for w in rng.choices(template, k=rng.randint(1, 4))] for _ in range(2)]
            around = [" ".join(f"{w} {prose(rng, rng.randint(3, 7))}" for w in stray) for stray in strays]
            lightly = [w.decode() for w in template]
            if trial % 2 and len(template) > 5:
                lightly[rng.randrange(1, len(template) - 1)] = "edited"
            found, _ = scanner.scan(f"{around[0]} {' '.join(lightly)} {around[1]}".encode())
            got = {x["license"]: x["coverage"] for x in found}
            least = 1.0 if "edited" not in lightly else (len(template) - 1) / len(template)
            assert got.get(name, 0) >= least - 1e-9


def test_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    found = license_scan.scan_licenses(docs)
    assert found.drop("_scan").columns == docs.columns and found.count() == len(odd_rows)
    assert all(r._scan.licenses == [] for r in found.collect())
    assert license_scan.scan_licenses(frame([])).count() == 0


def test_foreign_words_in_the_middle_up_to_the_limits():
    """Density and gap decide, and nothing else: one word more than they admit and the notice is not found."""
    notice = license_scan.TEMPLATES["gpl-3.0-notice"].split()
    n = len(license_scan.words(" ".join(notice).encode()))
    admitted = int(n / license_scan.DENSITY) - n

    def found(foreign, **how):
        text = " ".join([*notice[:15], *[f"zq{i}" for i in range(foreign)], *notice[15:]]).encode()
        names = [f["license"] for f in license_scan.Scanner(license_scan.TEMPLATES, **how).scan(text)[0]]
        return "gpl-3.0-notice" in names

    assert admitted > 9 and all(found(k) for k in (0, 8, 9, admitted)) and not found(admitted + 1)
    assert found(9, gap=9) and not found(10, gap=9)
    assert found(admitted + 5, density=0.4)


FULL = " ".join("""
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""".split())


def test_a_full_text_edited_and_embedded(frame):
    """A licence of many sentences with words changed, left out and put in, inside prose, is found; its first half is not."""
    rng, words = random.Random(4), FULL.split()
    edited = [w for i, w in enumerate(words) if i % 11] + ["indeed"] * 3
    for i in range(0, len(edited), 17):
        edited[i] = "whatever"
    rows = [(1, FULL), (2, f"{prose(rng, 300)} {FULL.upper()} {prose(rng, 300)}"), (3, f"{prose(rng, 50)} {' '.join(edited)} {prose(rng, 50)}"),
            (4, " ".join(words[:len(words) // 2])), (5, prose(rng, 500))]
    found = license_scan.scan_licenses(frame(rows), {"full": FULL}, keep=["doc_id"]).collect()
    hits = {r.doc_id: r._scan.licenses for r in found}
    assert [bool(hits[i]) for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    assert hits[1][0].coverage == 1.0 and hits[2][0].first == 300 and hits[2][0].last == 299 + hits[1][0].matched
