"""Packing, mixing, licences, search, token files and the pipeline."""

import collections
import random
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from entityframe.llm import license_scan, mixing, packing, simple8b, token_files, vp_search
from entityframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_registered_names():
    assert [sum(n.startswith(f"op{k}_") for n in Q.QUERIES) for k in range(1, 14)] == [1] * 13
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def naive_shard(pieces, capacity):
    """Every open bin looked at for every piece."""
    bins, out = [], {}
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i]["n_tokens"], pieces[i]["doc_id"], pieces[i]["cluster"], pieces[i]["piece"]))
    for i in order:
        p = pieces[i]
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= p["n_tokens"] and p["source"] not in b["s"] and p["cluster"] not in b["c"]]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[n]["room"] -= p["n_tokens"]
        bins[n]["s"].add(p["source"])
        bins[n]["c"].add(p["cluster"])
        out[i] = n
    return [out[i] for i in range(len(pieces))]


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(2)
    pieces = [{"doc_id": i, "piece": 0, "n_tokens": rng.randint(1, 100), "source": f"s{rng.choice([0, 0, 0, 1, 2, 3])}", "cluster": rng.randrange(150)} for i in range(300)]
    assert packing.pack_shard(pd.DataFrame(pieces), 100) == naive_shard(pieces, 100)


def test_pack_keeps_all_tokens_and_the_constraints(make, odd_rows):
    items = [*odd_rows, *[(100 + i, "w " * (i % 37)) for i in range(200)]]
    got = packing.pack(make(items, ["1 as bin_id", "2 as shard", "3 as size"]), capacity=64, shard_pieces=50).collect()
    words = sum(len((t or "").split()) for _, t in [(i[0], i[1] and i[1].replace("\x1f", "x").replace(" ", "x").replace("\xa0", "x")) for i in items])
    assert sum(r.n_tokens for r in got) == words
    bins = collections.defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for rows in bins.values():
        assert sum(r.n_tokens for r in rows) <= 64
        assert len({r.source for r in rows}) == len(rows) and len({r.cluster for r in rows}) == len(rows)
    assert packing.pack(make([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 7}, {"a": 97, "b": 2, "c": 1}, {f"s{i}": 1 + i % 5 for i in range(40)}])
def test_pfair_period(weights):
    rows, total = mixing.pfair_period(weights), sum(weights.values())
    assert sorted(r[4] for r in rows) == list(range(total))
    had = collections.Counter()
    for s, k, release, deadline, slot in sorted(rows, key=lambda r: r[4]):
        assert release <= slot < deadline and k == had[s]
        had[s] += 1
        for x, w in weights.items():
            assert abs(had[x] * total - (slot + 1) * w) < total  # under one block off, at every slot


def test_integer_weights():
    assert mixing.integer_weights({"a": 1, "b": 3}, 10) == {"a": 3, "b": 7}
    w = mixing.integer_weights({"a": 0.5, "b": 0.3, "c": 0.0}, 100)
    assert sum(w.values()) == 100 and w["c"] == 1 and abs(w["a"] - 61) <= 1
    assert sum(mixing.integer_weights({str(i): 1.0 for i in range(300)}, 256).values()) == 300


def test_schedule_follows_targets(make, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CHUNK", 50)
    items = [(i, "x", "big" if i % 3 else "small") for i in range(900)] + [(2000 + i, "x", None) for i in range(40)] + [(None, "y", "small"), (5, "x", "big"), (5, "x", "big")]
    docs = make(items, ["1 as slot", "2 as block"])
    got = mixing.schedule(docs, {"big": 0.25, "small": 0.75}, block_docs=4, period=16).collect()
    assert len(got) == len(items)
    for s in ("big", "small", None):
        own = sorted((r.slot, r.in_block) for r in got if r.source == s)
        assert len(set(own)) == len(own)  # every place of a source is taken once
    assert all(r.release <= r.slot < r.deadline for r in got)
    early = collections.Counter(r.source for r in got if r.slot < 96)
    assert abs(early["small"] / early["big"] - 10 / 4) < 0.8
    assert mixing.schedule(docs.limit(0)).count() == 0


def test_licences_are_found_where_they_are(make, odd_rows):
    rng = random.Random(3)
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    items, want = list(odd_rows), set()
    for i, (_, _, text) in enumerate(license_scan.TEMPLATES):
        for k, before in enumerate((0, 1, 2, 3, 7, 50)):
            items.append((1000 + 10 * i + k, f"{noise(before)} {text.upper() if k % 2 else text}. {noise(30)}"))
            want.add((1000 + 10 * i + k, i))
        words = text.split()
        if len(words) > 18:
            cut = words[: len(words) // 2] + ["really"] + words[len(words) // 2 :]
            items.append((5000 + i, f"{noise(20)} {' '.join(cut)} {noise(5)}"))
            want.add((5000 + i, i))
    items += [(9000, noise(3000)), (9001, "licensed under the stars, released under the moon " * 20)]
    got = license_scan.scan(make(items, ["1 as template", "2 as k"])).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert want <= found and all(r.containment >= 0.8 for r in got)
    assert not {r.doc_id for r in got} & {9000, 9001, 1, 2, 6, None}
    assert license_scan.scan(make([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(make(items), (("X", "y", "too short text"),))


def brute_nearest(ids, vectors, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 20 == 0:
            near = sorted((-float((q * v).sum()), j) for j, v in zip(ids, vectors) if j != i)[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def test_exact_search_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 8)).astype(np.float32)
    base[100:260] = base[100]  # one vector many times
    base[300:320] *= 3
    ids = rng.permutation(700)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, base)]
    odd = [(None, [1.0] * 8, 0), (2000, None, 0), (2020, [0.0] * 8, 0), (2040, [1.0, None] + [1.0] * 6, 0), (2060, [float("nan")] + [1.0] * 7, 0), (2080, [float("inf")] + [1.0] * 7, 0), rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, shard int")
    want = brute_nearest([r[0] for r in rows], base.astype(np.float64), 20)
    for sizes in ((8192, 2048), (100, 7)):
        got = collections.defaultdict(list)
        for r in vp_search.nearest(df, factor=1.0, shard_rows=sizes[0], query_rows=sizes[1]).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert {q: [(a, b) for a, b, _ in sorted(v)] for q, v in got.items()} == {q: [(a, b) for a, b, _ in v] for q, v in want.items()}
        assert all(abs(s - w[2]) < 1e-9 for q, v in got.items() for (_, _, s), w in zip(sorted(v), want[q]))
    assert vp_search.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [5.0, 5.0, 5.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vp_search.nearest(few).collect()] == [(0, 1, 1, 4.0)]


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    want = brute_nearest([r.vec_id for r in rows], np.array([r.embedding for r in rows]), 20)
    got = collections.defaultdict(set)
    for r in vp_search.nearest(df, shard_rows=100).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {b for _, b, _ in w}) / 20 for q, w in want.items()]) >= 0.95


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 5, 17, 300, 60000, 2**33, 2**63):
        for n in (0, 1, 7, 119, 120, 500, 4097):
            v = rng.integers(0, top, size=n, dtype=np.uint64)
            v[rng.random(n) < 0.3] = 0
            if n > 3 and top > 2**40:
                v[2] = 2**64 - 1
            assert (simple8b.decode(simple8b.encode(v), n) == v).all()
    assert len(simple8b.encode(np.zeros(240, np.uint64))) == 2 and len(simple8b.encode(np.full(8, 2**61, np.uint64))) == 16


def test_block_round_trip():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 9000, 12)
    ids = rng.integers(0, 50_000, int(lengths.sum()))
    names, sizes, values = token_files.unpack_block(token_files.pack_block(np.arange(12) - 4, lengths, ids))
    assert (names == np.arange(12) - 4).all() and (sizes == lengths).all() and (values == ids).all()
    with pytest.raises(ValueError):
        token_files.unpack_block(b"x" * 60)


def test_token_files(make, odd_rows):
    from tokenizers import Tokenizer

    items = [*odd_rows, (-7, "it's  two   blanks\n\n and <|endoftext|> inside"), (12, "tab\tand　wide space"), (2**40, "end ")]
    got = token_files.round_trip(make(items, ["1 as part", "2 as start"]), Q.tokenizer_path()).collect()
    tokenizer, at = Tokenizer.from_file(Q.tokenizer_path()), 0
    want = collections.Counter()
    for e, i in zip(tokenizer.encode_batch([i[1] or "" for i in items], add_special_tokens=False), items):
        ids = np.array([*e.ids, 2], dtype="<u4")
        want[i[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda d: -(2**63) if d is None else d)
    assert token_files.round_trip(make([(1, "x")]).limit(0), Q.tokenizer_path()).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    ids = {r.doc_id for r in out}
    assert ids and ids <= set(texts)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    assert all(sum(r.n_tokens for r in rows) <= 2048 and len({r.source for r in rows}) == len(rows) for rows in bins.values())


def test_each_stage_keeps_the_columns_and_handles_odd_rows(spark, make, odd_rows):
    docs = make([*odd_rows, *[(300 + i, f"{i} of the " * 30 + f"and in it is number {i}") for i in range(5)]])
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, "")
        assert got.columns == docs.columns, name
        assert got.count() <= docs.count()
        assert step(spark, docs.limit(0), "").count() == 0
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
