"""Fuzzy lines with shingles at every character."""

import collections
import random
import re

import pytest

import corpus_pipeline
from entityframe.llm import line_dedup
from entityframe.llm import queries as Q


def shingles_of(line):
    norm = re.sub(r"[\x20\x09-\x0d]+", " ", line).strip(" ").lower()
    return {norm[i : i + 12] for i in range(len(norm) - 11)}


def alike(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return 180 * len(a & b) >= 80 * (len(a) + len(b))


WORDS = " ".join(f"word{i}" for i in range(30))
PAIRS = [
    ("https://www.example.org/reports/2021/a", "https://www.example.net/other-site/blog/zzz"),
    ("这是一个没有空格的句子它的前十二个字符完全一样然后就开始不同了", "这是一个没有空格的句子它的前十二个字符和另外一行相同别的都两样"),
    ("see the list of files in 0123456789abcdefghijklmnopqrstuvwxyz", "see the list of files in 0123456789abzyxwvutsrqponmlkjihgfedc"),
    ("the address is at www.a-very-long-host-name.org", "the address is at www.a-very-quite-other-one.com"),
    ("https://www.example.org/" + "".join(f"/part{i}" for i in range(40)), "https://www.example.org/" + "".join(f"/part{i}" for i in range(40)) + "/x"),
    ("我们" + "".join(chr(0x4E00 + 37 * i % 9000) for i in range(150)), "我们" + "".join(chr(0x4E00 + 37 * i % 9000) for i in range(150)) + "了"),
    ("😀😁😂🤣" + "".join(chr(0x1F300 + i) for i in range(90)), "😀😁😂🤣" + "".join(chr(0x1F300 + i) for i in range(91))),
    (WORDS + " last", WORDS + " end"),
]


@pytest.mark.parametrize("step", ["op9", "pipeline"])
def test_whole_lines_are_compared(spark, make, tmp_path, step):
    docs = make([(10 * n + k, line) for n, pair in enumerate(PAIRS) for k, line in enumerate(pair)])
    if step == "op9":
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        kept = {r.doc_id for r in Q.op9_fuzzy_line_dedup(spark, str(tmp_path)).collect() if not r.n_removed}
    else:
        kept = {r.doc_id for r in corpus_pipeline.lines(spark, docs, "").collect()}
    want = {10 * n for n in range(len(PAIRS))} | {10 * n + 1 for n, pair in enumerate(PAIRS) if not alike(*pair)}
    assert [alike(*p) for p in PAIRS] == [False] * 4 + [True] * 4
    assert kept == want


def test_shingles_at_every_character(spark):
    lines = [b for pair in PAIRS for b in pair] + ["a" * 40, "x" * 11, "abcabcabcabcabcabcabc"]
    df = spark.createDataFrame([(x.lower(),) for x in lines], "norm string")
    got = df.select("norm", line_dedup.shingle_hashes(line_dedup.F.col("norm"), whole=True).alias("h")).collect()
    assert [len(r.h) for r in got] == [len(shingles_of(x)) for x in lines]
    names = collections.defaultdict(set)
    for r in got:
        names[frozenset(r.h)].add(frozenset(shingles_of(r.norm)))
    assert all(len(v) == 1 for v in names.values())


def test_whole_lines_match_brute_force(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij /") for _ in range(rng.randint(150, 400))) for _ in range(6)]
    lines = []
    for _ in range(80):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            x[rng.randrange(len(x))] = "#"
        lines.append("".join(x))
    got = line_dedup.dedup_lines(make([(i, x) for i, x in enumerate(lines)]), whole=True).collect()
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if group[a] != group[b] and alike(lines[a], lines[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert {r.doc_id for r in got if not r.n_removed} == set(group)


def test_short_lines_are_removed_where_equal(spark, make, tmp_path):
    items = [(1, "Les.\n\nLes.\nshort"), (2, "les. \n \t\nother\n\n今天天气很好我们去公园"), (3, "Les\n今天天气很好我们去公园\nshore"), (4, "ab  " + " " * 30 + "c"), (5, "ab c")]
    make(items).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in Q.op9_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 1), 2: (5, 1), 3: (3, 1), 4: (1, 0), 5: (1, 1)}
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(items), whole=True).collect()}
    assert text[1] == "Les.\n\nshort" and text[2] == " \t\nother\n\n今天天气很好我们去公园" and text[3] == "Les\nshore"
