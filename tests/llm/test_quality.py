"""Quality rules against a plain Python version, and the rule ensemble on held-out rows."""

import re
import zlib

from entityframe.llm import quality_model, quality_rules
from entityframe.llm.quality_model import Model, Term, tree_paths

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_rules_match_a_plain_version(make, odd_rows):
    items = [*odd_rows, (20, "a b c d e f g h " * 5), (21, "x y " * 3), (22, "# & | <> " * 30), (23, "same line here\n" * 30)]
    got = quality_rules.judge(make(items, ["upper(text) as words", "1 as kept", "2 as __words"])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert have == sorted(((i[0], *brute(i[1])) for i in items), key=key)
    assert all(not r.kept for r in got if r.base_failed)


def test_rules_on_an_empty_table(make):
    assert quality_rules.judge(make([(1, "x")]).limit(0)).count() == 0


def test_paths_become_tight_rules():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 3 <= 0.2)
      Predict: 1.0
     Else (feature 3 > 0.2)
      Predict: 0.0
    Else (feature 3 > 0.5)
     Predict: 0.0
"""
    marks = quality_model.FEATURES[3]
    rules = tree_paths(text)
    assert (Term(marks, True, 0.2),) in rules and (Term(marks, False, 0.5),) in rules
    assert (Term(marks, True, 0.5), Term(marks, False, 0.2)) in [tuple(sorted(r, key=lambda t: not t.at_most)) for r in rules]


def test_held_out_accuracy_and_shape(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_model.score(docs, quality_model.learn(docs, labels))
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held) and all(0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_without_labels_of_both_kinds(spark, make, odd_rows):
    docs = make(odd_rows, ["7 as label", "text as __text"])
    for labels, score in (([], 0.5), ([(1, 1, 0), (None, 0, 0), (2, 5, 0)], 0.999)):
        model = quality_model.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = quality_model.score(docs, model).collect()
        assert len(got) == len(odd_rows) and all(abs(r.score - score) < 1e-9 for r in got)
    assert isinstance(model, Model)
