import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrely.llm import language_id, quality, toxicity
from tests.llm.conftest import prose

SYLLABLES = {"aa": ("ka", "to", "mi", "nu"), "bb": ("bra", "ish", "ö", "ent"), "cc": ("éa", "oul", "que", "ren"), "dd": ("ña", "ción", "os", "ir"),
             "ee": ("wz", "szc", "ło", "ek")}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def labels(spark, pairs, name):
    return spark.createDataFrame(pairs, f"doc_id long, {name} int")


# ---- language identification ---------------------------------------------------

def test_codewords_tell_languages_apart():
    for n in (2, 3, 5, 7, 9, 40):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
        assert (np.abs(code.sum(axis=0)) < n).all()
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 999
        assert apart.min() >= 1 and (n < 8 or apart.min() > code.shape[1] / 5)


def test_held_out_languages(frame):
    rng = random.Random(1)
    rows = [(i, speak(rng, lang, rng.randint(2, 40)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    docs = frame(rows)
    model = language_id.fit(docs, language_id.training_rows())
    found = language_id.identify(docs, model).filter(~language_id.training_rows()).collect()
    assert len(found) > 100
    assert sum(r._lang.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r._lang.score <= 1 for r in found)


def test_every_language_is_learnt_however_rare(frame):
    """Also one whose only row hashes into the part set aside; texts of single rows are told apart."""
    rng = random.Random(6)
    names = [f"l{i}" for i in range(30)]
    letters = {k: "".join(chr(0x4E00 + 40 * i + j) for j in range(40)) for i, k in enumerate(names)}
    rows = [(4 * i, " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(30)), k) for i, k in enumerate(names)]
    docs = frame(rows)
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == sorted(names)
    assert sum(r._lang.lang_pred == r.lang for r in language_id.identify(docs, model).collect()) >= 28


def test_own_output_and_own_names_as_input(frame, odd_rows):
    docs = frame(odd_rows)
    model = language_id.fit(docs, language_id.training_rows())
    once = language_id.identify(docs, model)
    again = language_id.identify(once, language_id.fit(once, language_id.training_rows()))
    assert again.columns == once.columns and sorted(map(repr, again.collect())) == sorted(map(repr, once.collect()))


def test_decoding_equals_trying_every_codeword():
    """The codeword with the smallest weighted loss, by hand over all of them; a runner-up almost as near is flagged."""
    rng = np.random.default_rng(8)
    code = language_id.codewords(6)
    bits = code.shape[1]
    model = language_id.Model([f"l{i}" for i in range(6)], code, rng.normal(size=(language_id.BUCKETS, bits)).astype(np.float32) / 4,
                              rng.uniform(0.5, 2, bits), rng.uniform(0.1, 3, bits))
    for k in range(40):
        text = "".join(rng.choice(list("abcdefghij klmno"), 30)).encode()
        margins = model.margins(text)
        losses = [sum(model.trust[b] * np.log1p(np.exp(-3.0 * code[i, b] * margins[b] / model.scale[b])) for b in range(bits)) for i in range(6)]
        assert model.predict(text)[0] == f"l{int(np.argmin(losses))}"


def test_labels_outside_the_fit_do_not_matter(frame):
    rng = random.Random(2)
    rows = [(i, speak(rng, lang, 20), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=200))]
    docs = frame(rows)
    spoilt = docs.withColumn("lang", F.when(language_id.training_rows(), F.col("lang")).otherwise("zz"))
    got = [language_id.fit(df, language_id.training_rows()) for df in (docs, spoilt)]
    assert got[0].languages == got[1].languages == ["aa", "bb"] and np.array_equal(got[0].weights, got[1].weights)


def test_a_text_between_two_languages_is_flagged():
    model = language_id.Model(["aa", "bb"], language_id.codewords(2), np.zeros((language_id.BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    assert model.predict(b"anything") == ("aa", 0.5, True)


def test_languages_of_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    found = language_id.identify(docs, language_id.fit(docs, language_id.training_rows()))
    assert found.columns == [*[c for c in docs.columns if c != "_lang"], "_lang"] and found.count() == len(odd_rows)
    for r in found.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r._lang.lang_pred == "und") == (not letters)
    assert language_id.identify(frame([]), language_id.fit(frame([]), F.lit(True))).count() == 0
    unknown = frame([(1, "text", None)])
    assert language_id.identify(unknown, language_id.fit(unknown, F.lit(True))).first()._lang.lang_pred == "und"
    one = frame([(1, "text", "xx"), (2, "other", None)])
    assert {r._lang.lang_pred for r in language_id.identify(one, language_id.fit(one, F.lit(True))).collect()} == {"xx"}


def test_long_texts_are_read_to_the_end():
    points = language_id.characters(("ab " * 150_000 + "ö").encode())
    assert len(points) == 450_002 and points[-1] == ord("ö")


# ---- quality ----------------------------------------------------------------------

def noisy(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(("###", "&&&", "%%%")) for w in prose(rng, n).split())
    if kind == 1:
        return prose(rng, n).upper().replace(" ", "!! ")
    return " ".join([prose(rng, 1)] * n)


def test_held_out_quality(spark, frame):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(700):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, rng.randint(10, 80)).capitalize() + "." if good else noisy(rng, rng.randint(10, 80))))
        if rng.random() < 0.5:
            marks.append((i, int(good)))
    docs, known = frame(rows), labels(spark, marks + marks[:5] + [(9999, 1)], "quality")
    model = quality.fit(docs, known, quality.training_rows())
    assert abs(model.prior - 0.7) < 0.1
    got = {r.doc_id: r._quality.score for r in quality.score(docs, model).filter(~quality.training_rows()).collect()}
    judged = [(got[i] >= 0.5) == bool(q) for i, q in marks if i in got]
    assert len(judged) > 60 and np.mean(judged) > 0.95
    # No label of a bad text is used.
    assert np.array_equal(model.weights, quality.fit(docs, known.filter("quality = 1"), quality.training_rows()).weights)


def test_the_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    for prior in (0.2, 0.5, 0.8):
        positive, unlabelled = rng.normal(2, 1, 4000), np.where(rng.random(8000) < prior, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert abs(quality.estimate_prior(positive, unlabelled) - prior) < 0.06


def test_quality_of_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    for marks in ([(7, 1), (9, 1), (None, 1), (11, None)], []):
        model = quality.fit(docs, labels(spark, marks, "quality"), F.lit(True))
        found = quality.score(docs, model)
        assert found.drop("_quality").columns == docs.columns and found.count() == len(odd_rows)
        assert all(0 <= r._quality.score <= 1 for r in found.collect())
    assert quality.score(frame([]), quality.fit(frame([]), labels(spark, [], "quality"), F.lit(True))).count() == 0


def test_features_have_their_number():
    for text in (None, b"", b" \n", b"a", "É é".encode(), b"x" * 100_000, b"one two\nthree. http://x"):
        row = quality.features(text)
        assert len(row) == quality.FEATURES and np.isfinite(row).all()


# ---- toxicity -----------------------------------------------------------------------

def test_held_out_toxicity(spark, frame):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        toxic = rng.random() < 0.15
        words = prose(rng, rng.randint(15, 80)).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(("idiot", "stupid", "vrek" + rng.choice(words), "vrek" + rng.choice(words)))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            marks.append((i, int(toxic)))
    docs = frame(rows)
    model = toxicity.fit(docs, labels(spark, marks + marks[:4], "toxic"), toxicity.training_rows())
    assert any(w.startswith(b"vrek") for w in model.mined)
    got = {r.doc_id: r._toxicity.score for r in toxicity.score(docs, model).filter(~toxicity.training_rows()).collect()}
    toxic = [got[i] >= 0.5 for i, t in marks if t and i in got]
    clean = [got[i] >= 0.5 for i, t in marks if not t and i in got]
    assert len(toxic) > 8 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def test_voters_that_fire_together_share_their_evidence():
    rng = np.random.default_rng(1)
    toxic = rng.random(4000) < 0.3
    alone = (rng.random(4000) < np.where(toxic, 0.5, 0.05))
    pair = (rng.random(4000) < np.where(toxic, 0.5, 0.05))
    fired = np.stack([alone, pair, pair], axis=1)
    rows, columns = np.nonzero(fired)
    label = np.where(rng.random(4000) < 0.3, toxic, -1).astype(int)
    model, posterior = toxicity.fit_labels(toxicity.Votes(rows, columns, label), 3)
    assert model.correlation[1, 2] > 0.95 and model.correlation[0, 1] < 0.2
    assert model.share[1] == pytest.approx(0.5, abs=0.05) and model.share[0] > 0.9
    assert abs(model.prior - 0.3) < 0.1 and (model.evidence > 1).all()
    assert ((posterior >= 0.5) == toxic)[label >= 0].mean() > 0.9


def test_patterns():
    fired = lambda s: toxicity.patterns(s.encode(), toxicity.words(s.encode()), set(toxicity.words(s.encode())))
    assert 0 in fired("what an 1d10t") and 1 in fired("such an i d i o t here") and 2 in fired("you are stupid")
    assert 3 in fired("idiot and idiot " + "x " * 300) and 4 in fired("IDIOT") and fired("a kind text, 2024") == []


def test_toxicity_of_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    for marks in ([(7, 1), (9, 0), (None, 1), (11, None), (7, 1)], []):
        found = toxicity.score(docs, toxicity.fit(docs, labels(spark, marks, "toxic"), F.lit(True)))
        assert found.drop("_toxicity").columns == docs.columns and found.count() == len(odd_rows)
        assert all(0 <= r._toxicity.score <= 1 for r in found.collect())
    assert toxicity.score(frame([]), toxicity.fit(frame([]), labels(spark, [], "toxic"), F.lit(True))).count() == 0
