"""The filter audit against a plain version that applies every order, document by document."""

import collections
import itertools
import re

import pytest

from entityframe.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """Letters of the filters that each (doc_id, text) fails."""
    texts = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            texts[t or ""].append(i)
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        out.append(own + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and min(texts[t]) < i))
    return out


def plain(rows, labels):
    failed = fails([r[:2] for r in rows])
    parts = [r[2] or "" for r in rows]
    good = [any(x[0] == r[0] and x[1] == 1 for x in labels) and r[0] is not None for r in rows]
    toxic = [any(x[0] == r[0] and x[2] == 1 for x in labels) and r[0] is not None for r in rows]
    out, shapley = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, name in enumerate(order, 1):
            removed = [n for n in left if name in failed[n]]
            left = [n for n in left if name not in failed[n]]
            for p in set(parts):
                mine = [n for n in range(len(rows)) if parts[n] == p]
                gone = [n for n in removed if parts[n] == p]
                redundant = sum(name in failed[n] and any(x in failed[n] for x in order[: step - 1]) for n in mine)
                out[p, order, step] = (sum(parts[n] == p for n in left), len(gone), redundant, sum(failed[n] == name for n in mine), sum(good[n] for n in gone), sum(toxic[n] for n in gone))
                shapley[p, name] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, path, labels, **options):
    cells = filter_audit.count_masks(spark, path, spark.createDataFrame(labels, LABELS), **options)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(cells).collect()}


@pytest.mark.parametrize("batches", [1, 7])
def test_smaller_ids_arrive_late(spark, make, odd_rows, tmp_path, batches):
    prose = [" ".join(f"w{(7 * i + k) % 90}" for k in range(30 + 10 * i)) for i in range(8)]
    rows = [(i, t, f"s{(i or 0) % 3}") for i, t in odd_rows if i is None or i > 2 or t is None]
    rows += [(1, odd_rows[0][1], "s0"), (1, odd_rows[0][1], "s1"), (2, odd_rows[0][1], None), (None, prose[0], "s9")]
    rows += [(1000 - 10 * n - k, prose[(n + k) % 8] + ("#" if k % 3 == 0 else "") + ("ABCDEFGH" * (n % 3)), [None, "", "hot", "hot"][n % 4]) for n in range(12) for k in range(9)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1000, 850, -3)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    path = str(tmp_path / "documents.parquet")
    for n, at in enumerate(range(0, len(rows), 18)):  # larger ids first
        chunk = [(i, t, s) for i, t, s in rows[at : at + 18]]
        df = spark.createDataFrame([(i, t, s, 0) for i, t, s in chunk], "doc_id long, text string, source string, n_chars long").selectExpr("*", "1 as mask", "2 as n", "'x' as part", "3 as key")
        df.coalesce(1).write.mode("append").parquet(path)
    assert result(spark, path, labels, batches=batches) == plain(rows, labels)


def test_earlier_masks_are_taken_back(spark, tmp_path):
    """The counters of one text over four batches: those of the earlier rows move when a smaller id arrives."""
    counters = filter_audit.Counters(spark, str(tmp_path), 1)

    def send(number, *rows):
        df = spark.createDataFrame([(bytearray(key), i, part, 2, 0, 0) for key, i, part in rows], filter_audit._ROWS)
        for _ in range(2):  # a batch that runs again changes nothing
            counters.add(df, number)
        found = spark.read.parquet(f"{tmp_path}/counts/{number}").select("part", "mask", "n").collect()
        return sorted(map(tuple, found))

    assert send(0, (b"k", 5, "p")) == [("p", 2, 1)]
    assert send(1, (b"k", 5, "p"), (b"k", 9, "q"), (b"k", None, "q")) == [("p", 2, 1), ("q", 2, 1), ("q", 18, 1)]
    assert send(2, (b"k", 3, "q"), (b"k", 4, "q"), (b"j", 4, "q")) == [("p", 2, -2), ("p", 18, 2), ("q", 2, 2), ("q", 18, 1)]
    assert send(3, (b"k", 4, "p"), (b"k", 3, "z")) == [("p", 18, 1), ("z", 2, 1)]
    assert sorted(map(tuple, counters.cells(4).select("part", "mask", "n").collect())) == [("p", 18, 3), ("q", 2, 3), ("q", 18, 2), ("z", 2, 1)]


def test_empty_table(spark, make, tmp_path):
    path = str(tmp_path / "documents.parquet")
    make([(1, "x")]).limit(0).write.parquet(path)
    assert result(spark, path, [(1, 1, 1)]) == {}
