import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netquarry.llm import pieces, token_counts

TEXTS = ["", None, " ", "\n\n", "Hello, World's 123!", "ΑΣ Σ İ ǅ", "a<|endoftext|>b <|startoftext|>", "  two  spaces ", "▁mark ▁▁", "\x00\x01😀漢字é", "<0x41></s><s>", "word " * 3000, "x" * 5000]
NASTY = st.text(st.sampled_from("aAbΣéÉ ½\n\t\x1c\x85  ▁'st12!?😀漢<|>endoftxf") | st.characters(exclude_categories=["Cs"]), max_size=40)


@pytest.fixture(scope="module")
def word_bpe():
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        return token_counts.WordBpe(f.read()), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def piece_bpe():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_counts_equal_the_library(word_bpe, text):
    ours, library = word_bpe
    assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merges_take_lowest_rank_leftmost_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert token_counts.merges(list("abc"), ranks) == 2
    assert token_counts.merges(list("aab"), ranks) == 1
    assert token_counts.merges(["a"], ranks) == 0


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_pieces_equal_the_library(piece_bpe, text):
    ours, library = piece_bpe
    ids, begins, ends, decoded = ours.encode(text)
    want = library.encode(text, add_eos=True)
    assert np.frombuffer(ids, np.int32).tolist() == want
    assert decoded.decode() == library.decode(want) == ours.decode(want).decode()
    spans = library.encode(text, return_type="proto").pieces
    assert np.frombuffer(begins, np.int32).tolist()[:-1] == [x.begin for x in spans]
    assert np.frombuffer(ends, np.int32).tolist()[:-1] == [x.end for x in spans]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_normalising_through_a_character_map(piece_bpe, rule):
    """The compiled maps of the library's own rules, with trimming, against the library's normaliser."""
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto())
    ours = pieces.Pieces.__new__(pieces.Pieces)
    ours.norm, ours.map = proto.normalizer_spec, pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    random.seed(3)
    alphabet = list("aBé ½㍿ｶﾞ①Ａ　\t\n  ﬀ漢") + ["  ", "é"]
    for text in ["", " ", "  a  b  ", "㍿", *("".join(random.choices(alphabet, k=random.randint(0, 15))) for _ in range(400))]:
        got, where = ours.normalise(text)
        assert got.replace("▁", " ") == library.normalize(text).replace("▁", " ")
        assert len(where) == len(got.encode()) + 1 and where == sorted(where)


def test_decoding_broken_bytes(piece_bpe):
    ours, library = piece_bpe
    for ids in ([3 + 0xE6, 3 + 0xBC], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [3 + 0xFF, 300, 3 + 0x80], [0, 5, 2], []):
        assert ours.decode(ids).decode() == library.decode(ids)


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[4] if len(texts) > 4 else None, None)] * 2, "doc_id long, text string, n_tokens string")


def test_frames(spark, word_bpe, piece_bpe):
    df = frame(spark)
    got = token_counts.count_tokens(df, P.path("word_bpe_49k.json"), limit=100).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(word_bpe[1].encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    found = pieces.encode(df, P.path("piece_bpe_32k.model"))
    rows = found.collect()
    assert sorted(tuple(r.ids) for r in rows) == sorted(tuple(piece_bpe[1].encode(r.text or "", add_eos=True)) for r in df.collect())
    assert all(r.ends[-1] == r.n_bytes for r in rows)
    back = pieces.decode(found, P.path("piece_bpe_32k.model")).collect()
    assert sorted(r.text for r in back) == sorted(r.decoded for r in rows)
    empty = df.where("false")
    assert token_counts.count_tokens(empty, P.path("word_bpe_49k.json")).count() == 0
    assert pieces.encode(empty, P.path("piece_bpe_32k.model"), spans=False).count() == 0
