import random

from curata.llm import quality


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(2)
    good = ["the", "and", "then", "other", "inter", "where", "thing"]
    docs, labels = [], []
    for i in range(400):
        words = r.choices(good, k=r.randint(5, 80))
        bad = i % 4 == 0
        docs.append((i, " ".join(w + r.choice(["$$$", "***", "!!"]) if bad else w for w in words), "en", 1.0))
        labels.append((i, int(not bad)))
    docs += [(900, None, "en", 1.0), (901, "", "en", 1.0), (None, "the and", None, 1.0), (3, docs[3][1], "en", 1.0)]
    labels += [(None, 1), (5, None), (1, labels[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, lab)
    rows = quality.classify(df, model, keep=["doc_id"]).withColumn("held", quality.held_out()).collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 for x in rows)
    held = [x for x in rows if x.held and x.doc_id is not None and x.doc_id < 400]
    assert held and sum(x.predicted == int(x.doc_id % 4 != 0) for x in held) >= 0.95 * len(held)
    empty = {x.score for x in rows if x.doc_id in (900, 901)}
    assert len(empty) == 1
    long = spark.createDataFrame([(1, "the and then " * 200_000), (2, "$$$ *** " * 200_000), (3, "the and then")], "doc_id long, text string")
    scores = {x.doc_id: x.score for x in quality.classify(long, model).collect()}
    assert abs(scores[1] - scores[3]) < 0.2 and scores[1] > scores[2]
    tie = quality.classify(long, model, threshold=scores[1]).collect()
    assert {x.doc_id: x.predicted for x in tie if x.doc_id != 3} == {1: 1, 2: 0}  # a score that equals the threshold is predicted 1
    nothing = quality.fit(df.limit(0), lab)
    assert {x.predicted for x in quality.classify(df, nothing).collect()} == {1}
    assert quality.classify(df.limit(0), model).count() == 0
