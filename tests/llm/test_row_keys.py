"""Ids with several texts, rows without ids, and languages without a list of stop words."""

import corpus_pipeline
from entityframe.llm import near_dup, quality_rules

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))


def test_an_id_with_two_texts_keeps_the_links_of_both(make):
    rows = [(1, A), (1, B), (2, B + " more"), (3, A + " more"), (4, "something else that stands alone here")]
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(make(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    later = [(5, A), (2, B), (5, B + " more"), (7, A + " more")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make(later)).collect())
    assert got == [(2, 56, 2), (5, 56, 5), (5, 57, 2), (7, 57, 5)]


def test_the_pipeline_keeps_one_row_of_each_group(spark, make):
    rows = [(1, A), (1, A), (1, B), (2, B + " more"), (None, A + " x"), (None, "alone without an id in five words"), (9, "unique words of its own here")]
    kept = corpus_pipeline.near_duplicates(spark, make(rows, ["1 as __key", "2 as kept"]), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    texts = sorted(r.text for r in kept.collect())
    assert len(texts) == 4
    assert sum("alpha0 " in t for t in texts) == 1 and sum("beta0 " in t for t in texts) == 1


def test_languages_without_stop_words_are_kept(spark):
    text = "Быстрая рыжая лиса прыгает через ленивую собаку и бежит домой " * 2
    text = " ".join(f"{w}{i}" for i, w in enumerate(text.split() * 2))
    junk = " ".join(f"xq{i}" for i in range(40))
    rows = [(1, text, "ru"), (2, text, "RU"), (3, text, "en"), (4, text, None), (5, junk, "pl"), (6, junk, "DE")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality_rules.judge(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
