"""The rebuilt tokenizer against the sentencepiece library, and round trips."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from conftest import SMALL
from helpers import empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from visitcast.llm import sentencepiece_codec as s

MODEL = Path(s.default_model()).read_bytes()


@pytest.fixture(scope="module")
def codec():
    return s.Codec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁ab<>")), max_size=60))
def test_parity_and_round_trip(text):
    c = s.codec(MODEL)
    ids = c.encode([text])[0]
    assert ids.tolist() == c.reference.encode(text)
    assert c.decode([ids])[0] == text.replace("▁", " ")


def test_library_alone_agrees(codec):
    """The tokenizers model gives the library's ids without help on the corpus' words."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = codec.encode(texts)
    assert codec.differing == 0 and [x.tolist() for x in ids] == codec.reference.encode(texts)
    assert codec.decode_by_library(ids) == codec.decode(ids) == texts


def test_memory_is_bounded_in_bytes(monkeypatch):
    """Neither many words nor texts of one unit each stay in the worker beyond the bound."""
    monkeypatch.setattr(s, "REMEMBERED", 20_000)
    r = random.Random(1)
    c = s.Codec(MODEL)
    for k in range(20):
        text = "".join(r.choice("abcdefgh") for _ in range(9000)) if k % 3 == 0 else " ".join(f"x{r.randint(0, 90)}" for _ in range(60))
        assert c.encode([text])[0].tolist() == c.reference.encode(text)
        size = lambda known: sum(len(u) + len(x) for u, x in known.items())
        assert size(c.known) <= 20_000 + 50_000 and size(c.older) <= 40_000


def _model(extra: list[tuple[str, float, int]]) -> bytes:
    """A unigram model with byte fallback, spelled out by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_id = 0
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("▁a", -3.2, 1), ("ab", -3.3, 1), ("▁ab", -4.0, 1), ("bab", -4.4, 1), *extra]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    return m.SerializeToString()


@pytest.mark.parametrize(("extra", "splits"), [([], True), ([("ab▁b", -3.4, 1)], False)])
def test_unigram_model(extra, splits):
    """Both libraries agree, unit by unit and, where a piece holds a marker inside, text by text."""
    c = s.Codec(_model(extra))
    assert c.splits == splits
    for text in ("abab ba", "a", "", "bab abab  aab", "aé b", "ab b ab bab"):
        ids = c.encode([text])[0]
        assert ids.tolist() == c.reference.encode(text) and c.decode([ids])[0] == text
    assert c.differing == 0


def test_query(spark):
    got = s.op2_sentencepiece(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    c = s.codec(MODEL)
    assert len(got) == len(texts) and all(r.round_trip and r.n_differing == 0 and r.n_tokens == len(r.token_ids) for r in got)
    assert all(r.token_ids == c.reference.encode(texts[r.doc_id]) for r in got[:50])


def test_odd_rows(spark):
    df = odd(spark)
    out = s.encode(df)
    got = out.collect()
    assert len(got) == 12 and out.columns[:13] == df.columns
    assert all((r._token_ids is None) == (r.text is None) and r._round_trip for r in got)
    assert next(r for r in got if r.doc_id == 2)._token_ids == []
    back = s.decode(out.selectExpr("doc_id", "text", "_token_ids AS token_ids")).collect()
    assert all(r._decoded == r.text for r in back)
    assert s.encode(empty(spark)).count() == 0
    assert np.array_equal(s.Codec(MODEL).encode(["x"])[0], s.codec(MODEL).encode(["x"])[0])
