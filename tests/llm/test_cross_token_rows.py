"""What the alignment of two tokenizers holds at once: a document, a slice of a block, a row group; not a partition."""

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from entityframe.llm import cross_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(n):
    return [" ".join(f"word{i * 7 % 90} and{i + j}" for j in range(i % 40)) + ("\tend" if i % 9 == 0 else "") for i in range(n)]


def test_rows_stay_as_small_as_a_document(spark, make, monkeypatch):
    monkeypatch.setattr(cross_tokens, "SMALL_GROUPS", {"parquet.block.size": "65536", "parquet.page.size.row.check.max": "100"}, raising=False)
    done = cross_tokens.blocks(make(list(enumerate(texts(800)))).coalesce(1), A, B)
    rows = done.collect()
    held = [sum(len(v) for v in r if isinstance(v, (bytes, bytearray, list))) for r in rows]
    assert len({r.block for r in rows}) == 1
    assert max(held) < sum(held) / 100
    (file,) = [f for f in done.inputFiles() if pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows]
    assert pq.ParquetFile(file.removeprefix("file://")).num_row_groups > 1


@pytest.mark.parametrize(("chars", "pieces"), [(1, 1), (700, 13)])
def test_slices_do_not_matter(monkeypatch, chars, pieces):
    given = [*texts(120), None, "", "漢字 😀", "x" * 3000]
    ids = [*range(len(given) - 1), None]
    pair = cross_tokens.tokenizer_pair(A, B)
    want = [b.to_pylist() for b in pair.block(5, ids, given)]
    assert [len(rows) for rows in want] == [len(given), len({r["pair"] for r in want[1]})]
    pair.codes._clear()
    most, encoded = [], pair.a.encode_batch_fast
    monkeypatch.setattr(cross_tokens, "SLICE_CHARS", chars)
    monkeypatch.setattr(cross_tokens, "ENCODED", pieces)
    monkeypatch.setattr(pair, "_a_texts", lambda own: most.append(len(own)) or [e.ids for e in encoded(own, add_special_tokens=False)])
    assert [b.to_pylist() for b in pair.block(5, ids, given)] == want
    assert max(most) <= pieces
