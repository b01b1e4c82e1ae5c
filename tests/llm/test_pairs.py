"""Byte-pair ids against the published encoder, on odd texts and whole tables."""

import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from pyspark.errors import PySparkException

from ledgerloom.llm import common, pairs
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.tokens import PATTERN, read_ranks
from tests.conftest import SF


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    random = np.random.default_rng(5)
    letters = list("aab'sreltvmd  \t\n é中文字ab12३.,!\U0001F600\x00\u2581'\x1c\x85")
    out = [None, "", " ", "\n", "'s", "it's 'tis we'll they're x''s's ' s '", "  a", "\t\ta \n b  ", "a\xa0 b", "<|endoftext|>", "''re", "'r", "a'"]
    out += ["".join(random.choice(letters, n)) for n in random.integers(0, 60, 400)]
    # long words: one letter, two letters, random letters, unspaced script
    out += ["a" * 3000, "ab" * 200, "".join(random.choice(list("aeiou"), 1500)), "中文字" * 60]
    out += ["".join(random.choice(list("abcdeflmnoprstuvwxyz"), n)) for n in (63, 64, 65, 130, 1200)]
    out += ["".join(map(chr, random.integers(0x4E00, 0x9FFF, 700))), "the quick brown fox " * 3000]
    return out


def test_ids_are_the_published_encoders(spark, coder):
    common.ship(spark)
    texts = odd_texts()
    rows = [(None if i == 3 else i // 2, t, "x", [1]) for i, t in enumerate(texts + texts[:5])]
    table = spark.createDataFrame(rows, "doc_id long, text string, h string, ids array<int>").repartition(3)
    got = pairs.decode(pairs.encode(table)).collect()
    wanted = [(i, coder.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.ids, bytes(r.text)) for r in got), key=order) == sorted(wanted, key=order)


def test_character_classes_are_the_published_encoders():
    classes = np.frombuffer(pairs.character_classes(), np.uint8)
    some = [i for i in range(0x80, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    assert classes[some].tolist() == pairs._by_asking("".join(map(chr, some)))


def test_small_vocabulary_with_cheap_late_pairs():
    """Contracting a pair may bring up one of lower rank, which then comes first."""
    words = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"aba", b"bc", b"ca", b"abab", b"cab"]
    ranks = {w: i for i, w in enumerate(words)}
    reference = tiktoken.Encoding("tiny", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = pairs.Coder(b"\n".join(base64.b64encode(w) + b" %d" % i for w, i in ranks.items()))
    classes = np.frombuffer(pairs.character_classes(), np.uint8)
    random = np.random.default_rng(2)
    for n in [*range(1, 40), 65, 66, 70, 90, 150, 300]:
        text = "".join(random.choice(list("abc"), n))
        data = np.frombuffer(text.encode(), np.uint8)
        assert mine.encode(data, np.array([0, n]), classes).to_pylist() == [reference.encode_ordinary(text)], text


def test_decoding_alone(spark):
    rows = [(1, [64, 65]), (1, None), (None, [])]
    got = pairs.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    assert sorted(bytes(r.text) for r in got)[:2] == [b"", b""] and len(got) == 3
    with pytest.raises(PySparkException, match="no such id"):
        pairs.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pairs.decode(pairs.encode(none)).columns == ["doc_id", "ids", "text"]
    assert pairs.decode(pairs.encode(none)).count() == 0


def test_query_over_the_whole_table(spark, coder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = {}
    for r in docs:
        ids = coder.encode_ordinary(r.text or "")
        wanted[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256((r.text or "").encode()).hexdigest())
    got = QUERIES["op11_byte_pairs"](spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == wanted
