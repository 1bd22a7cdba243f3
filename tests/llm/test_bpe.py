import base64
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from semaspan.llm import bpe
from semaspan.llm.queries import PATTERN, RANKS


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


KNOWN = bpe.vocabulary(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, text):
    assert KNOWN.ids(text).tolist() == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abenorstiühé '1\n ", max_size=120))
def test_words(library, text):
    assert KNOWN.ids(text).tolist() == library.encode_ordinary(text)


def test_long_pieces_take_linear_time(library):
    for text in ("a" * 50_000, "ab" * 20_000, " " * 30_000, "".join(random.Random(3).choices("aeinst", k=60_000))):
        assert KNOWN.ids(text).tolist() == library.encode_ordinary(text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for doc_id, text, ids in bpe.with_tokens(docs, RANKS, PATTERN).collect():
        assert ids == library.encode_ordinary(text)


def test_odd_rows_and_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "<|endoftext|> é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.with_tokens(docs, RANKS, PATTERN)
    back = out.select("doc_id", "token_ids", bpe.decode("token_ids", RANKS, PATTERN).alias("b"))
    got = sorted(((r.doc_id or 0, len(r.token_ids), bytes(r.b).decode()) for r in back.collect()))
    assert [g[0] for g in got] == [0, 1, 2, 2] and [g[2] for g in got] == ["<|endoftext|> é", "", "", ""]
    assert bpe.with_tokens(docs.limit(0), RANKS, PATTERN).count() == 0


def test_decoding_needs_no_automata(monkeypatch):
    monkeypatch.setattr(bpe, "Vocabulary", lambda *a: pytest.fail("decoding builds the encoder's tables"))
    bpe.vocabulary.cache_clear()
    ids = [KNOWN.ids(t).tolist() for t in ("one text", "", "éa 1")] * 400
    lists = pa.array(ids, pa.list_(pa.int32())).slice(1)
    parts = list(bpe.spelled_out(iter([lists]), RANKS))
    assert max(map(len, parts)) <= bpe.ROWS_AT_ONCE
    assert [b.decode() for p in parts for b in p.to_pylist()] == (["one text", "", "éa 1"] * 400)[1:]
