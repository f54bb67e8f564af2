import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, key string, shard string, score string, n long, fp string, h string, a string, body string, kept string, block string, _lang string, _rate string, _shard string, _keeper string, _node string, _row string"
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "ra", "su", "ti") for b in ("n", "r", "s", "la", "mo", "ve", "zu", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with further columns whose names operators use themselves."""
    def make(rows, clashing=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
        if not clashing:
            return spark.createDataFrame(full, SCHEMA)
        return spark.createDataFrame([(*r, 5, "k", "s", "x", 1, "f", "h", "a", "b", "no", "b", "l", "r", "s", "k", "n", "r") for r in full], f"{SCHEMA}, {CLASHING}")
    return make


@pytest.fixture
def odd_rows():
    """Nulls, blanks, one very long text, ties, repeated rows and identifiers."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 40)
    return [
        (1, None, "xx", "s1"), (2, "", None, None), (3, " \n\t ", "xx", "s2"), (4, "... !!", "xx", "s1"), (5, "one two", "yy", None),
        (6, "One TWO", "yy", "s2"), (7, same, "xx", "s1"), (8, same.upper(), "xx", "s1"), (8, same.upper(), "xx", "s1"),
        (9, long, "yy", "s2"), (10, long + " end", "yy", "s2"), (None, same, None, "s1"), (None, None, None, None),
        (11, prose(rng, 60), "xx", "s1"), (12, "É é É", "yy", "s3"), (11, prose(rng, 50), "yy", "s1")]
