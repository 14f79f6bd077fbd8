import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.tokens import PieceIds, default_tokenizer

WHOLE, PIECES = Tokenizer.from_file(default_tokenizer()), PieceIds(default_tokenizer())
ODD = ["", " ", "a", "The, THE. the!", "Éaux ßtraße ÑU Ǆ İstanbul ΣΑΣ", "x́ ́y é", "it's we'll I'd've 'SAID", "a\x1cb\x85c d\xa0e", "<|endoftext|> x<|startoftext|>y", "12,5 3.14 ½ ²", "日本語、テスト。", "a\tb\r\nc\x0bd\x0ce", "fiﬁ ŉ ǰ", "ªº µ ĳ", "ẞÅΩ", "Ⱥ ȺB ɏɎ K", "x" * 5000, "</w> a</w>b", "\n\n", "é" * 700]


def ids(texts):
    flat, n = PIECES.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    return [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def whole(texts):
    return [WHOLE.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_whole_texts_ids(text):
    assert PIECES.by_piece
    assert ids([text]) == whole([text])


def test_many_texts_at_a_time():
    texts = [*ODD, None, "", "end", "1", "2", *ODD[::-1]]
    assert ids(texts) == whole(texts)
    assert PIECES.encode(pa.array([], pa.string()))[0].size == 0
    flat, n = PIECES.encode_ended(pa.array([None, "a b", ""], pa.string()), 7)
    assert flat.tolist() == [7, *whole(["a b"])[0], 7, 7] and n.tolist() == [1, len(whole(["a b"])[0]) + 1, 1]
    part = pa.array(["skipped", *texts], pa.string()).slice(1)
    assert PIECES.encode(part)[0].tolist() == [i for x in whole(texts) for i in x]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,'\n\taéÈsSß<|>09")), max_size=60), max_size=5))
def test_any_texts(texts):
    assert ids(texts) == whole(texts)


def test_other_tokenizers_are_used_whole(tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, lib = PieceIds(path), Tokenizer.from_file(path)
    assert not other.by_piece
    flat, n = other.encode(pa.array(["Ab c's\n12", "", "é"], pa.string()))
    assert flat.tolist() == [i for t in ("Ab c's\n12", "", "é") for i in lib.encode(t, add_special_tokens=False).ids] and len(n) == 3
