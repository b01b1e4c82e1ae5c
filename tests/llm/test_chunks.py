"""Texts of a batch in chunks: every row once, in order, whatever the slices."""

import pyarrow as pa
import pytest

from ledgerloom.llm import common as C

TEXTS = ["", None, "é", "a b", "x" * 50] * 700


@pytest.mark.parametrize("slice_rows", [1, 7, 1024, 10**6])
@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_every_row_once(slice_rows, limit):
    column = pa.array(TEXTS, pa.string()).slice(3, 3001)
    seen = []
    for texts in C.text_chunks(column, limit, slice_rows):
        assert len(texts) == len(texts.rows) == len(texts.starts) - 1 <= slice_rows
        for i, row in enumerate(texts.rows):
            seen.append((row, texts.data[texts.starts[i]: texts.starts[i + 1]].tobytes().decode()))
    assert seen == [(i, t or "") for i, t in enumerate(column.to_pylist())]


def test_one_chunk_when_asked():
    column = pa.array(TEXTS, pa.string())
    assert len(next(C.text_chunks(column, 1 << 40, len(column)))) == len(TEXTS)
