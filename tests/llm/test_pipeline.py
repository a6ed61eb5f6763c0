import re

import corpus_pipeline as p
from curata.llm import common
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    from test_decontaminate import brute as windows
    from test_jaccard import brute as groups

    more = DIR.replace("0.001", "0.01")  # enough labels to fit on
    docs = common.table(spark, more, "documents")
    kept = common.cut(p.keep_quality(spark, docs, more))
    assert kept.columns == COLUMNS
    rejected = docs.join(kept, "doc_id", "left_anti").join(common.table(spark, more, "labels"), "doc_id").select("quality").collect()
    assert rejected and all(r.quality == 0 for r in rejected)
    kept = common.table(spark, DIR, "documents")
    one = common.cut(p.keep_one_of_each(spark, kept, DIR))
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in groups(texts)})
    clean = common.cut(p.drop_contaminated(spark, one, DIR))
    items = [(r.item_id, r.text) for r in common.table(spark, DIR, "benchmark").collect()]
    want = {r[0] for r in windows([(r.doc_id, r.text) for r in one.collect()], items) if not r[-1]}
    assert {r.doc_id for r in clean.collect()} == want
    safe = common.cut(p.redact_secrets(spark, clean, DIR))
    assert safe.columns == COLUMNS and safe.count() == clean.count()
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|(?<![0-9a-f])[0-9a-f]{24,}", r.text) or len(r.text) != r.n_chars for r in safe.collect())
    done = p.tokenize(spark, safe, DIR)
    assert done.count() == len(want)


def test_repeated_rows_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, "en", "s", 1), (None, t, "en", "s", 1), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in p.keep_one_of_each(spark, df, DIR).collect()) == ["1", "3", "4", "None"]
    assert p.keep_one_of_each(spark, df.limit(0), DIR).count() == 0


CLASHING = ["score", "predicted", "_hits", "_words", "_items", "_slot", "_maybe", "key_", "page_", "bits_", "maybe_", "kept_0", "_base", "_spans", "component_id", "times"]


def test_extra_columns_nulls_repeats_and_no_rows(spark):
    more = DIR.replace("0.001", "0.01")
    docs = common.table(spark, more, "documents").limit(60)
    odd = spark.createDataFrame([(None, "null id and password = hunter2hunter2", "en", "s", 38), (70001, None, "en", "s", None), (70002, "", "en", "s", 0), (70003, "Same text twice over.", "en", "s", 21), (70003, "Same text twice over.", "en", "s", 21)], docs.schema)
    whole = common.cut(docs.unionByName(odd).withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for x in CLASHING}))
    for stage in (p.keep_quality, p.drop_near_copies, p.drop_contaminated, p.redact_secrets):
        out = stage(spark, whole, more)
        assert out.columns == whole.columns
        rows = out.collect()
        assert rows and all(r[x] == f"{x}{'?' if r.doc_id is None else r.doc_id}" for r in rows for x in CLASHING)
        empty = stage(spark, whole.limit(0), more)
        assert empty.columns == whole.columns and empty.count() == 0
        ids = [r.doc_id for r in rows]
        if stage is p.drop_near_copies:
            assert ids.count(70003) == 1 and None in ids and {70001, 70002} <= set(ids)
        if stage in (p.drop_contaminated, p.redact_secrets):
            assert ids.count(70003) == 2 and len({None, 70001, 70002} & set(ids)) == 3
        if stage is p.redact_secrets:
            assert next(r.text for r in rows if r.doc_id is None) == "null id and [REDACTED]"
    done = p.tokenize(spark, whole, more)
    assert done.count() == whole.count() and p.tokenize(spark, whole.limit(0), more).count() == 0


def test_run_is_the_stages_in_order(spark):
    more = DIR.replace("0.001", "0.01")
    docs = common.table(spark, more, "documents")
    for _, stage in p.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, more))
    want = sorted(map(tuple, p.STAGES[-1][1](spark, docs, more).collect()))
    assert sorted(map(tuple, p.run(spark, more).collect())) == want and len(want) > 100
