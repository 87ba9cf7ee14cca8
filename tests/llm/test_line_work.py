"""What is done to a line, and that it is done once."""

from pyspark.sql import functions as F

from entityframe.llm import line_dedup

FACE, MARK = "\U0001f600", "\ufeff"


def test_texts_are_split_and_lines_normalised_once(make):
    rows = line_dedup._identified(make([(1, "a line\nand  one more")]), "doc_id", "text")
    plan = line_dedup._lines(rows, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(") == 1 and plan.count("split(") == 1


def test_shingles_with_characters_beyond_two_bytes(spark):
    """Equal shingles have equal hashes in every kind of line, others different ones; a byte order mark counts as a character."""
    plain, short = "an ordinary line é", f"{FACE} too short"[:11]
    lines = [plain, FACE + plain, f"{plain[:12]}{FACE * 3}", MARK + plain, f"{MARK}{plain}{FACE}", MARK * 2 + plain, short, "", FACE * 12, FACE * 13]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, norm string")
    sets = {r.key: list(r.h) for r in df.select("key", line_dedup._at_characters(F.col("norm")).alias("h")).collect()}
    rows = line_dedup.hashed(df, whole=True).groupBy("key").agg(F.collect_list("h").alias("h")).collect()
    assert {k: sorted(h) for k, h in sets.items() if h} == {r.key: sorted(r.h) for r in rows}

    want = {n: [x[i : i + 12] for i in range(len(x) - 11)] for n, x in enumerate(lines)}
    assert all(len(sets[n]) == len(want[n]) for n in want)
    of = {s: h for n in want for s, h in zip(want[n], sets[n], strict=True)}
    assert all(of[s] == h for n in want for s, h in zip(want[n], sets[n], strict=True))
    assert len(set(of.values())) == len(of)
