"""Problems 6 and 7: ids against two public libraries, packing against its invariants."""

import os
from collections import defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm import byte_bpe, packing, queries
from tests.conftest import SF_SMALL

PATH = os.path.join(byte_bpe.TOKENIZERS, byte_bpe.BYTE_BPE_50K)
BPE = byte_bpe.ByteBpe(byte_bpe.read_vocabulary(PATH))
TIK = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


@given(st.text(max_size=60) | st.text(alphabet="abent '\n1é漢", max_size=400))
@settings(max_examples=300, deadline=None)
def test_ids_equal_public_library(text):
    assert BPE.encode(text) == TIK.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "antidisestablishment" * 1000, "<|endoftext|>x", "漢字" * 3000, "\n" * 5000, "ab" * 9999 + "é"])
def test_long_pretokens_and_special_strings(text):
    assert BPE.encode(text) == TIK.encode_ordinary(text)


def test_rank_queue_returns_least():
    q = byte_bpe.RankQueue(300_000)
    for rank in (299_999, 64, 4096, 63, 64):
        q.push(rank, rank)
    seen = []
    while (r := q.least()) >= 0:
        seen.append((r, len(q.take(r))))
    assert seen == [(63, 1), (64, 2), (4096, 1), (299_999, 1)]


def test_p6_query_and_defined_cases(spark):
    hf = Tokenizer.from_file(os.path.join(byte_bpe.TOKENIZERS, "byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs.itertuples():
        text = r.text if isinstance(r.text, str) else ""
        assert got[r.doc_id] == hf.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, None, 7), (1, "", 7), (2, "<|endoftext|>", None), (2, "<|endoftext|>", None)], "doc_id int, text string, ids int")
    rows = byte_bpe.encode_texts(df).collect()
    assert [r.ids for r in rows[:2]] == [[], []] and rows[2].ids == rows[3].ids == TIK.encode_ordinary("<|endoftext|>")
    assert byte_bpe.encode_texts(df.limit(0)).count() == 0


def check_packing(rows, sizes, capacity):
    inside, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        inside[r.container_id].append((r["at"], r.n_tokens))
        pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
    for spans in inside.values():
        at = 0
        for start, n in sorted(spans):
            assert start >= at or n == 0
            at = max(at, start + n)
        assert at <= capacity
    assert set(pieces) == set(sizes)
    for doc, parts in pieces.items():
        at = 0
        for i, (piece, start, n) in enumerate(sorted(parts)):
            assert piece == i and start == at
            at += n
        assert at == sizes[doc]
        assert len(parts) == 1 or sizes[doc] > capacity
    return sum(sizes.values()) / (capacity * len(inside))


def test_packing_invariants_through_several_levels(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").repartition(9, "doc_id")
    sizes = {r.doc_id: len(BPE.encode(r.text or "")) for r in docs.collect()}
    rows = packing.pack(docs, windows=3, fan_in=2).collect()
    assert check_packing(rows, sizes, packing.CAPACITY) > 0.8
    rows = packing.pack(docs, capacity=64, windows=8).collect()
    check_packing(rows, sizes, 64)


def test_packing_of_empty_tables_and_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id int, text string")
    rows = packing.pack(df).collect()
    check_packing(rows, {1: 0, 2: 0, 3: len(BPE.encode("  "))}, packing.CAPACITY)
    assert len(rows) == 3 and all(r.container_id is not None for r in rows)
    assert packing.pack(df.limit(0)).count() == 0
