"""Near duplicates, fuzzy lines and repeated bytes against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from entityframe.llm import line_dedup, near_dup, shingles, suffix_dedup
from entityframe.llm.components import components
from entityframe.llm.loser_tree import LoserTree, common_prefix

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, times, sep=" "):
    parts = text.split(sep)
    for _ in range(times):
        parts[rng.randrange(len(parts))] = f"edit{rng.randrange(10**6)}"
    return sep.join(parts)


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 7)] + [(1, k) for k in range(200, 260)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e} - {7}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def test_shingles_follow_the_words():
    texts = ["a b c d", "A  b\tc\nd", "a b", "", " \n", "ab c d", "a b c a b c a b c", "Ä b c"]
    sets = shingles.shingle_sets([shingles.lowered(t) for t in texts], 3)
    assert [len(s) for s in sets] == [len(brute_sets(t, 3)) for t in texts]
    assert (sets[0] == sets[1]).all() and not set(sets[2].tolist()) & set(sets[5].tolist())


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, make, odd_rows, width, percent):
    rng = random.Random(width)
    items, n = list(odd_rows), 100
    for _ in range(12):
        base = prose(rng, rng.randint(40, 160))
        for times in (0, 1, 2, 3, 5, 9, 9, 9):
            items.append((n, edited(rng, base, times)))
            n += 1
    items += [(n, prose(rng, 2)), (n + 1, "W1 w2"), (n + 2, "w1  W2")]
    got = near_dup.near_duplicates(make(items, ["doc_id as component_id", "1 as rep", "2 as key"]), width, percent).collect()
    own = {i[0]: brute_sets(i[1], width) for i in items if i[0] is not None}
    ids = sorted(own)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(own[a] & own[b])
            if own[a] and own[b] and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                links.append((a, b))
    want = roots(ids, links)
    assert len(got) == len(items)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_blocks_find_links_a_hub_misses(spark, make, monkeypatch):
    """A family whose members are all near the threshold: many blocks, none of the links lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(4)
    base = prose(rng, 60)
    items = [(i, edited(rng, base, rng.randint(1, 4))) for i in range(90)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(items), 3, 80).collect()}
    own = {i: brute_sets(t, 3) for i, t in items}
    links = [(a, b) for a in own for b in own if a < b and 180 * len(own[a] & own[b]) >= 80 * (len(own[a]) + len(own[b]))]
    assert got == roots(own, links)


def test_block_links_cross_sides_only():
    sets = [np.arange(10, dtype=np.uint64)] * 4
    one = np.array([0, 1, 2, 3])
    assert len(near_dup.block_links(one, one, np.array([0, 0, 1, 1]), sets, 80)) == 3
    assert near_dup.block_links(one, np.zeros(4, int), np.zeros(4, int), sets, 80) == []
    assert near_dup.block_links(np.empty(0, int), np.empty(0, int), np.empty(0, int), [], 80) == []


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    odd, shift = near_dup.permutations(200)
    x, y = np.concatenate(near_dup.min_max(a, odd, shift)), np.concatenate(near_dup.min_max(b, odd, shift))
    assert abs((x == y).mean() - 0.5) < 0.05


def brute_lines(items):
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    order = sorted({(i[0], i[1] or "") for i in items}, key=lambda i: (i[0] is None, i[0] or 0))
    places = collections.defaultdict(list)
    for n, (_, text) in enumerate(order):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= 24 and len(norm(line)) >= 24:
                places[norm(line)].append((n, k))
    keys = sorted(places)
    sets = [{x[i : i + 12] for i in range(len(x) - 11) if x[i] != " " and (i == 0 or x[i - 1] == " ")} for x in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]))]
    group = roots(range(len(keys)), links)
    of = collections.defaultdict(list)
    for i, x in enumerate(keys):
        of[group[i]] += places[x]
    gone = {p for at in of.values() for p in sorted(at)[1:]}
    return {row: "\n".join(x for k, x in enumerate(row[1].split("\n")) if (n, k) not in gone) for n, row in enumerate(order)}


def test_line_dedup_matches_brute_force(make, odd_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(9)
    lines = [prose(rng, rng.randint(30, 60)) for _ in range(10)]
    items = [*odd_rows, (50, "short\nshort\n\nshort"), (51, "Some  LONGER line of text, thirty\nsome longer line of text, thirty \n")]
    for n in range(60):
        picked = [edited(rng, rng.choice(lines), rng.choice([0, 0, 1, 1, 9])) for _ in range(3)]
        items.append((100 + n, "\n".join([prose(rng, 12), *picked, ""])))
    want = brute_lines(items)
    got = line_dedup.dedup_lines(make(items, ["1 as key", "2 as n_lines", "3 as norm"])).collect()
    assert len(got) == len(items)
    for r in got:
        assert r.n_lines >= r.n_removed >= 0 and r.key == 1
    ours = collections.Counter((r.doc_id, r.text or "") for r in got)
    assert ours == collections.Counter((i[0], want[i[0], i[1] or ""]) for i in items)


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(0, 9)):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 12)))
            runs.append((s, [0] + [common_prefix(a, b, 0) for a, b in zip(s, s[1:])]))
        got = list(LoserTree(runs).merge())
        out = [runs[r][0][i] for r, i, _ in got]
        assert out == sorted(x for s, _ in runs for x in s)
        assert all(got[k][2] == common_prefix(out[k - 1], out[k], 0) for k in range(1, len(out)))


def brute_bytes(items):
    order = sorted(items, key=lambda i: (i[0] is None, i[0] or 0))
    first, out = {}, collections.Counter()
    at = lambda i: (i[0] is None, i[0] or 0)
    for i in order:
        b = (i[1] or "").encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (at(i), k))
    for i in order:
        b = (i[1] or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (at(i), k):
                cut[k : k + 100] = b"\1" * 100
        kept = bytes(c for c, m in zip(b, cut) if not m)
        spans = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        out[i[0], len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_match_brute_force(make, odd_rows):
    rng = random.Random(5)
    passage, items = prose(rng, 80), [*odd_rows, (30, "z" * 350), (31, "ab" * 200), (32, "z" * 99), (33, "z" * 100)]
    for n in range(40):
        a = rng.randrange(200)
        items.append((200 - n, prose(rng, 30) + passage[a : a + rng.choice([60, 99, 100, 101, 180])] + " é" + prose(rng, 10) + rng.choice(["", passage])))
    for block in (1 << 30, 3000):
        got = suffix_dedup.remove_repeats(make(items, ["1 as block", "text as docs"]), block_bytes=block).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(items)


def test_repeats_on_an_empty_table(make):
    assert suffix_dedup.remove_repeats(make([(1, "x")]).limit(0)).count() == 0
    assert near_dup.near_duplicates(make([(1, "x")]).limit(0)).count() == 0
    assert line_dedup.dedup_lines(make([(1, "x")]).limit(0)).count() == 0


def test_runs_round_trip():
    block = suffix_dedup.Block(np.array([4, 9]), np.array([False, False]), np.array([300, 640]), (b"abcde" * 60 + bytes(range(200)) + b"x" * 140))
    again = suffix_dedup.Block.load(block.dump())
    assert again.bytes == block.bytes and (again.ends == block.ends).all()
    run, _ = suffix_dedup.block_suffixes(block, np.unique(suffix_dedup.anchors(block).hash))
    text = np.ascontiguousarray(run.right).view("S100").ravel()
    run = run.take(np.lexsort((run.reach, text)))
    back, shares = suffix_dedup.Run.load(run.dump())
    assert (back.right == run.right).all() and (back.left == run.left).all() and (back.at == run.at).all() and (shares == run.shares()).all()
