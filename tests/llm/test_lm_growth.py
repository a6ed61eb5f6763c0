import random

import numpy as np
import public_tokenizers
from curata.llm import bpe, lm


def chain():
    """Texts in which each word all but settles the next, and which word starts a text is chance."""
    r = random.Random(4)
    words = [a + b for a in ["the", "tion", "ing", "er", "re", "on", "and", "st"] for b in ["al", "en", "it", "or", "us"]]
    docs = []
    for i in range(240):
        k = r.randrange(len(words))
        text = []
        for _ in range(r.randint(50, 150)):
            text.append(words[k])
            k = (k * 7 + 3) % len(words) if r.random() < 0.9 else r.randrange(len(words))
        docs.append((i, " ".join(text)))
    return docs


def test_classes_and_shares_count_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_IDS", 500)
    fitted, drawn_parts = [], lm.drawn_parts

    def noted(units, counts):
        drawn, n_parts = drawn_parts(units, counts)
        found = {r.part: np.split(np.frombuffer(r.ids, np.int32), np.cumsum(r.sizes)[:-1]) for r in drawn.collect()}
        assert drawn.count() == len(found) and found.keys() <= set(range(n_parts))
        fitted.append((counts, [found.get(k, []) for k in range(n_parts)], n_parts))
        return drawn, n_parts

    monkeypatch.setattr(lm, "drawn_parts", noted)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    monkeypatch.setattr(lm, "ROUND_STEPS", 2)
    docs = [*chain(), (None, "a null id trains")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path = public_tokenizers.path(bpe.VOCABULARY)
    want = np.zeros(len(bpe.vocabulary(path).lengths))
    for row in bpe.encode(df.where(~lm.held_out("doc_id", 10)), "text", ["doc_id"], path).collect():
        np.add.at(want, row.ids, 1)
    for part in (128, 8, 2):
        monkeypatch.setattr(lm, "FIT_PART", part)
        lm.fit(df)
    assert all((counts == want).all() for counts, *_ in fitted)
    sizes = [sum(len(t) for p in parts for t in p) for _, parts, _ in fitted]
    assert sizes[0] < sizes[1] < sizes[2] < want.sum()
    assert all(len(parts) == n for _, parts, n in fitted)
    assert fitted[0][2] < fitted[1][2] < fitted[2][2]


def test_model_beats_words_where_context_tells(spark):
    df = spark.createDataFrame(chain(), "doc_id long, text string").repartition(4)
    rows = [r for r in lm.score(df, lm.fit(df)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_all_training_texts_are_fitted_on_and_each_window_is_taken(spark, monkeypatch):
    units = lm.encoded(spark.createDataFrame(chain(), "doc_id long, text string").repartition(3))
    n_ids = len(bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)).lengths)
    counts = lm.id_counts(units, n_ids)
    parts, n = lm.drawn_parts(units, counts)
    found = parts.collect()
    assert n == len(found) == 3
    assert (sum(np.bincount(np.frombuffer(r.ids, np.int32), minlength=n_ids) for r in found) == counts).all()

    monkeypatch.setattr(lm, "ROUNDS", 4)
    monkeypatch.setattr(lm, "BATCH", 7)
    m = lm.attention.begin(counts.astype(float), np.zeros(n_ids, int))
    ids, sizes = np.frombuffer(found[0].ids, np.int32), np.array(found[0].sizes, np.int64)
    taken, forward = [], lm.attention.Model.forward
    monkeypatch.setattr(lm.attention.Model, "forward", lambda self, x: taken.append(x.copy()) or forward(self, x))
    state = lm.attention.state_of(m)
    for number in range(4):
        state = lm.trained_on(m, state, number, 1, found[0].part, ids, sizes)
    x = lm.attention.windows(*lm.attention.sequence(m, ids, sizes))[0]
    assert {w.tobytes() for w in np.concatenate(taken)} == {w.tobytes() for w in x}
    assert len(np.concatenate(taken)) < len(x) + 4 * 4 * 7


def test_a_round_takes_its_parts_from_units_in_one_pass(spark, monkeypatch):
    units = lm.encoded(spark.createDataFrame(chain(), "doc_id long, text string").repartition(3))
    n_ids = len(bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)).lengths)
    counts = lm.id_counts(units, n_ids)
    m = lm.attention.begin(counts.astype(float), np.zeros(n_ids, int))
    state = lm.attention.state_of(m)
    plans, collect = [], type(units).collect
    monkeypatch.setattr(type(units), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    monkeypatch.setattr(lm, "ROUNDS", 1)
    monkeypatch.setattr(lm, "ROUND_STEPS", 2)
    fitted = lm.fit(None, units=units)
    assert plans[-1].count("MapInArrow") == 1  # it was one pass that made parts and one that trained on them
    drawn, parts = lm.drawn_parts(units, counts)
    fixed = lm.attention.begin(counts.astype(float), np.zeros(n_ids, int))
    assert np.allclose(lm._round(units, fixed, state, 0, parts), lm._round(drawn, fixed, state, 0, parts), atol=1e-5)
    assert not np.array_equal(fitted.embed, m.embed)
