"""Exact encoding by the tokenizers library, many texts at a time.

For a tokenizer whose normaliser is NFC, white space to one space, lower case, whose pre-tokenizer keeps contractions,
runs of letters, single digits and runs of other characters, and whose model is byte-level, a text's ids are those of
its pieces one after another. Pieces of plain characters are cut by numpy over the bytes of all texts at once,
equal pieces are found by Arrow's dictionary encoding, and the distinct pieces are encoded by the library's own model. A word with any other character (apostrophes, control characters, scripts beyond Latin Extended-B, the start of a
special token) is encoded whole by the tokenizer, and so are all texts for other tokenizers. Nothing is kept from call
to call, so a worker's memory is bounded by the texts of one call.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from quarry.llm.common import joined_bytes

_HELD: dict[str, "PieceIds"] = {}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte that has no visible character as the next free one from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
#: Fixed values of the tokenizers that are cut here.
_KINDS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_TOP = 0x250


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the code points below _TOP."""
    kind, low = np.full(_TOP, ODD, np.uint8), np.arange(_TOP, dtype=np.uint16)
    for cp in range(_TOP):
        c = chr(cp)
        small, group = c.lower(), unicodedata.category(c)
        if len(small) != 1 or ord(small) >= _TOP or (cp < 128) != small.isascii() or unicodedata.normalize("NFC", c) != c or c == "'":
            continue
        low[cp] = ord(small)
        if c in " \t\n\r":
            kind[cp] = SPACE
        elif group[0] == "L":
            kind[cp] = LETTER
        elif c in "0123456789":
            kind[cp] = DIGIT
        elif group[0] in "PS":
            kind[cp] = OTHER
    return kind, low


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceIds:
    """Ids of many texts at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.size, bool)
        if suffix := getattr(self.model, "end_of_word_suffix", None):
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.visible = np.array([_BYTES.get(b, b) for b in range(256)], "<u2")
        self.visible[32] = 32
        self.kind, self.low = _classes()
        self.kind8 = np.concatenate([self.kind[:128], np.full(128, ODD, np.uint8)])
        self.low8 = np.concatenate([self.low[:128].astype(np.uint8), np.arange(128, 256, dtype=np.uint8)])
        part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        steps, cuts = part(self.tokenizer.normalizer).get("normalizers", []), part(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = [s["type"] for s in steps] == _KINDS and steps[1]["pattern"] == {"Regex": r"\s+"} and len(cuts) == 2 and all(t[:2] == "<|" and not any(map(str.isspace, t)) for t in added)
        self.by_piece = self.by_piece and cuts[0].get("pattern", {}).get("Regex") == _SPLIT and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]

    def _of_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces on end, number of ids of each): one call of the model's own tokenizer for all of them."""
        data, bounds = joined_bytes(distinct)
        text = self.visible[np.insert(data, bounds[1:], 32)].tobytes().decode("utf-16-le")
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(distinct):
            each = [[t.id for t in self.model.tokenize(x)] for x in text[:-1].split(" ")]
            return np.array([i for x in each for i in x], np.uint32), np.array(list(map(len, each)), np.int64)
        return ids, np.diff(ends, prepend=-1)

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.array(list(map(len, made)), np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each); a null is an empty text."""
        data, bounds = joined_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if not self.by_piece:
            return self._of_words([data[b:e].tobytes() for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        n = len(data)
        kind, low = self.kind8[data], self.low8[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # two bytes, of which the second is always there
        if len(lead):
            cp = ((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)
            lead, cp = lead[cp < _TOP], cp[cp < _TOP]
            kind[lead] = kind[lead + 1] = self.kind[cp]
            small = self.low[cp]
            low[lead], low[lead + 1] = 0xC0 | (small >> 6), 0x80 | (small & 0x3F)
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        odd = kind == ODD
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        if odd.any():
            blank = kind == SPACE
            starts, ends = ~blank, ~blank
            starts[1:] &= blank[:-1]
            ends[:-1] &= blank[1:]
            starts[first] = ~blank[first]
            last = np.append(first[1:], n) - 1
            ends[last] = ~blank[last]
            starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            words = np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1)
            mark = np.zeros(n + 1, np.int8)
            mark[starts[words]] = 1
            mark[ends[words]] -= 1
            kind[np.cumsum(mark[:-1], dtype=np.int8) > 0] = ODD
        edge = kind == DIGIT
        edge[1:] |= kind[1:] != kind[:-1]
        edge[first] = True
        begin = np.flatnonzero(edge)
        of = kind[begin]
        size = np.diff(np.append(begin, n))
        inked = of != SPACE
        begin, size, of = begin[inked], size[inked], of[inked]
        plain = of != ODD
        offsets = np.concatenate([[0], np.cumsum(size[plain])])
        letters = low[(kind != SPACE) & (kind != ODD)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        flat, n_ids = self._of_pieces(coded.dictionary)
        at = np.zeros(len(begin), np.int64)
        at[plain] = coded.indices.to_numpy()
        if not plain.all():
            place: dict[bytes, int] = {}
            raw, known = data.tobytes(), len(n_ids)
            at[~plain] = [known + place.setdefault(raw[b : b + k], len(place)) for b, k in zip(begin[~plain].tolist(), size[~plain].tolist(), strict=True)]
            more, n_more = self._of_words(list(place))
            flat, n_ids = np.concatenate([flat, more]), np.concatenate([n_ids, n_more])
        place_of = np.cumsum(n_ids) - n_ids
        each = n_ids[at]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(place_of[at] - total[:-1], each) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(begin, bounds)])

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the end id after each text."""
        ids, n = self.encode(column)
        return np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False), n + 1


def piece_ids(path: str) -> PieceIds:
    """One per Python worker."""
    if path not in _HELD:
        _HELD[path] = PieceIds(path)
    return _HELD[path]
