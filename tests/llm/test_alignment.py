"""Alignment of two tokenizers against the plain definition, over whole texts."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, common
from ledgerloom.llm.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(alignment.A_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_VOCABULARY)


def spans(entries):
    ends = np.cumsum([len(e) for e in entries]).tolist()
    return list(zip([0, *ends], ends))


def plainly(texts, tools):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by comparing all byte ranges."""
    a, b = tools
    letters = alignment.byte_letters()
    seen, counts = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        by_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("\u2581", " ").encode() for p in map(b.id_to_piece, ids_b)]
        wanted = (" " + (text or "")).encode()
        if not text or b"".join(by_a) != wanted or b"".join(by_b) != wanted:
            seen.append((0, 0, 0, [], None))
            continue
        at_a, at_b = spans(by_a), spans(by_b)
        shared = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for high in shared:
            mine = [",".join(str(i) for i, (s, e) in zip(ids, at) if low <= s and e <= high) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            groups.append("|".join(mine))
            low = high
        links = [(i, j) for i, (s, e) in zip(ids_a, at_a) for j, (u, v) in zip(ids_b, at_b) if s < v and u < e]
        counts.update(links)
        seen.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, j), c in counts.items():
        best[j] = max(best[j], c)
    return [(n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups or "")
            for n_a, n_b, n_groups, links, groups in seen]


def odd_texts():
    random = np.random.default_rng(3)
    letters = list("aab'sretlvm dd  \n\t,.!?1 23éü中文\U0001F600\u2581ß")
    out = [None, "", " ", "  ", "a", " a", "a ", "a  b", "<s> </s> <unk> <0x41> x", "say <|endoftext|> now", "\u2581 x", "\x00 a", "\ufb01 x",
           "e\u0301 a", "\xa0a b\xa0", "don't we'll it's ' s", "unbelievably internationalisation", "\u3000 wide", "line\nline\r\n end"]
    out += ["".join(random.choice(letters, n)) for n in random.integers(1, 60, 250)]
    return out + ["antidisestablishmentarianism " * 40, "中文字" * 30, "x" * 300]


def as_tuples(frame):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in frame.orderBy("doc_id").collect()]


@pytest.mark.parametrize("sent", [1 << 20, 60, 0])
def test_figures_are_those_of_the_definition(spark, tools, tmp_path, monkeypatch, sent):
    common.ship(spark)
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    texts = odd_texts()
    texts += texts[20:60]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id int, text string, row long, groups string, pair long").repartition(4)
    space = common.Workspace(spark, "align")
    got = as_tuples(alignment.scored(space.keep(alignment.aligned(table), "aligned"), space))
    assert got == plainly(texts, tools)
    assert sum(r[0] > 0 for r in got) > 100


def test_tokenised_as_they_stand_when_spaces_do_not_separate(tools):
    with open(alignment.A_VOCABULARY, encoding="utf-8") as first, open(alignment.B_VOCABULARY, "rb") as second:
        a, b = alignment.byte_level(first.read()), alignment.pieces(second.read())
    assert a.local and b.local
    texts = [t for t in odd_texts() if t] + ["one two  three, four. 5 six\nseven eight"]
    cut = list(alignment.Texts(a, b).of(texts))
    b.local = False
    assert cut == list(alignment.Texts(a, b).of(texts))


def test_stretches_forgotten_between_texts_are_worked_out_again(monkeypatch):
    with open(alignment.A_VOCABULARY, encoding="utf-8") as first, open(alignment.B_VOCABULARY, "rb") as second:
        a, b = alignment.byte_level(first.read()), alignment.pieces(second.read())
    texts = [t for t in odd_texts() if t] * 2
    whole = list(alignment.Texts(a, b).of(texts))
    monkeypatch.setattr(alignment, "REMEMBERED", 7)
    few = alignment.Texts(a, b)
    assert whole == [x for i in range(0, len(texts), 9) for x in few.of(texts[i: i + 9])]
    assert len(few.number) < len(alignment._SINGLE_SPACE.split(" ".join(texts)))


def test_empty_table(spark):
    space = common.Workspace(spark, "align")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(space.keep(alignment.aligned(none), "aligned"), space).count() == 0


def test_query_over_the_whole_table(spark, tools):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    short = [i for i, (_, t) in enumerate(docs) if len(t or "") < 4000]
    got = QUERIES["op12_alignment"](spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    wanted = plainly([docs[i][1] for i in short], tools)
    for i, w in zip(short, wanted):
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) == w[:4]
        assert got[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
