"""Alignment of two tokenizers against a plain version: whole texts, a pointer a side, counts in a dictionary."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from entityframe.llm import cross_tokens
from entityframe.llm import queries as Q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Results by row number, from the definition."""
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    level = cross_tokens._byte_level(a_side)
    spell = cross_tokens._piece_bytes(b_side)
    kept, count = [], collections.Counter()
    for _, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(level[i] for i in a) != raw or b"".join(spell[i] for i in b) != raw:
            a, b = [], []
        links, groups, i, j, ea, eb, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a):
            if not own[0] or own[0][-1][0] != i:
                own[0].append((i, a[i]))
            if not own[1] or own[1][-1][0] != j:
                own[1].append((j, b[j]))
            links.append((a[i], b[j]))
            x, y = ea + len(level[a[i]]), eb + len(spell[b[j]])
            if x <= y:
                i, ea = i + 1, x
            if y <= x:
                j, eb = j + 1, y
            if x == y:
                groups.append(own)
                own = ([], [])
        text = ";".join("|".join(",".join(str(t) for _, t in side) for side in g) for g in groups)
        kept.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        count.update(links)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(d, n_a, n_b, g, len(l), sum(count[x] == most[x[1]] for x in l), sum(count[x] for x in l), s) for (d, _), (n_a, n_b, g, l, s) in zip(rows, kept, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


ODD = [
    (20, "two  blanks"), (21, " leading"), (22, "trailing "), (23, "a\n\nb"), (24, "\nfirst"), (25, "tab\tand\r\nline"), (26, "no break   space"),
    (27, "<|endoftext|> and <s> </s> <0x41> <unk>"), (28, "a▁b"), (29, "nul\0 in it"), (30, "漢字かな and 😀😀 emoji\n漢字"), (31, "é ﬁ Å ½"),
    (32, "line one\nline two\nthird"), (33, "x"), (34, "\n"), (35, " "), (36, "a" * 3000), (37, "ab" * 400 + " " + "c d " * 300 + "e"), (38, "\x85a b"), (39, " a\x1cb"),
]


@pytest.mark.parametrize("chars", [1 << 22, 2000])
def test_odd_texts(spark, make, odd_rows, chars):
    rows = [*odd_rows, *ODD]
    docs = make(rows, ["1 as block", "2 as pair", "3 as n_a"]).repartition(3)
    got = order(tuple(r) for r in cross_tokens.align(docs, A, B, block_chars=chars).collect())
    assert got == order(plain([(r[0], r[1]) for r in rows]))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = Q.op12_lockstep_alignment(spark, "/root/testdata/sf0.001")
    got = order(tuple(r) for r in out.collect())
    assert got == order(plain(rows)) and sum(r[4] for r in got) > 10_000
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_table_and_no_tokens(spark, make):
    assert cross_tokens.align(make([(1, "x")]).limit(0), A, B).count() == 0
    got = [tuple(r) for r in cross_tokens.align(make([(1, None), (2, "")]), A, B).collect()]
    assert order(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_matter(lane):
    rng = np.random.default_rng(4)
    sides = [np.unique(np.append(rng.integers(1, 400, 150), 400)) for _ in range(2)]
    sides = [np.concatenate([s, 400 + np.unique(np.append(rng.integers(1, 90, 30), 90))]) for s in sides]
    a, b, a_cut, b_cut = cross_tokens.merge(*sides, lane=lane)
    want = [(np.searchsorted(sides[0], e), np.searchsorted(sides[1], e)) for e in np.union1d(*sides)]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want
    common = np.intersect1d(*sides)
    assert sides[0][a_cut].tolist() == common.tolist() == sides[1][b_cut].tolist()
