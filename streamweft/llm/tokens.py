"""Exact, fast encoding with a word-end BPE of the tokenizers library.

The library normalises and pre-tokenises anew for every text.  White space
never lies within a token of such a vocabulary, so a text's ids are its words'
ids in a row.  Words of plain Latin letters, digits and signs are lower-cased
and cut into the pre-tokeniser's pieces by numpy, on the bytes; their pieces go
to the merge rounds of ``bpe``.  Any other word stays whole and goes through the
library's full chain.  Each batch's distinct pieces are encoded once (Arrow
dictionary encoding finds them), and numpy puts the ids together.

The shortcut holds for one chain of normaliser, pre-tokeniser and model options,
which ``Encoder`` compares with the file's; any other file goes through the
library, text by text.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa

from .bpe import Merges
from .words import buffers

DEFAULT = "word_bpe_49k.json"
#: Bytes of a piece that numpy merges; longer ones go to the library.
MAX_PIECE = 64

_LOADED: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte (0 space, 1 letter, 2 digit, 3 sign), and whether a word that has it is odd."""
    kind, odd = np.full(256, 3, np.uint8), np.ones(256, bool)
    kind[[32, 9, 10, 11, 12, 13]] = 0
    for b in range(256):
        if chr(b).isalpha() and b < 128 or b >= 128:
            kind[b] = 1
        elif 48 <= b <= 57:
            kind[b] = 2
    odd[33:127] = False
    odd[[32, 9, 10, 11, 12, 13, 0xC3]] = False
    odd[[ord("'"), ord("<")]] = True
    return kind, odd


_KIND, _ODD = _byte_tables()


#: What the shortcut takes for granted.
_CHAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None, "padding": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _expected(spec: dict) -> bool:
    added = spec.get("added_tokens") or []
    return (
        all(spec.get(k) == v for k, v in _CHAIN.items())
        and all(spec["model"].get(k) == v for k, v in _MODEL.items())
        and all(t["content"].startswith("<|") and not t["normalized"] for t in added)
        and {c + e for c in _byte_letters().values() for e in ("", spec["model"].get("end_of_word_suffix") or "")} <= set(spec["model"]["vocab"])
    )


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.quick = _expected(spec)
        if self.quick:
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "", _byte_letters())
        self.vocab_size = self.full.get_vocab_size()

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_distinct``, a text being one piece."""
        found = [e.ids for e in self.full.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        sizes = np.array([len(f) for f in found], np.int64)
        return np.arange(len(found) + 1), np.arange(len(found)), np.array([i for f in found for i in f], np.int64), sizes

    def _distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece offsets by text, each piece's code, the codes' ids in a row and the number of each code's."""
        if not self.quick:
            return self._whole(texts)
        none = np.zeros(0, np.int64)
        data, offsets = buffers(texts)
        kind = _KIND[data]
        space = kind == 0
        if space.all():
            return np.zeros(len(offsets), np.int64), none, none, none
        odd = _ODD[data]
        wide = np.flatnonzero(data[1:] >= 0x80) + 1
        wide = wide[(data[wide - 1] == 0xC3) & (data[wide] < 0xC0)]  # U+00C0 to U+00FF
        odd[wide] = (data[wide] == 0x97) | (data[wide] == 0xB7)
        starts = ~space
        starts[1:] &= space[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        starts[inner] = ~space[inner]
        at = np.flatnonzero(starts)
        plain = np.ones(len(data), bool)
        strange = np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1)
        if len(strange):  # words that stay whole
            size = np.append(at, len(data))[strange + 1] - at[strange]
            plain[np.repeat(at[strange] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = False
        cut = kind[1:] != kind[:-1]
        cut |= kind[1:] == 2
        starts[1:] |= cut & plain[1:] & ~space[1:]
        lower = data.copy()
        lower[(data >= 65) & (data <= 90) & plain] += 32
        high = wide[plain[wide] & (data[wide] < 0x9F)]
        lower[high] += 32
        lower[space] = 32
        at = np.flatnonzero(starts)
        ends = np.append(at, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(lower))
        coded = pieces.dictionary_encode()
        codes, table = coded.indices.to_numpy(), coded.dictionary
        # one row of each code, without the white space after it
        row = np.empty(len(table), np.int64)
        row[codes[::-1]] = np.arange(len(codes))[::-1]
        size = ends[row + 1] - at[row]
        tail = np.flatnonzero(space[ends[row + 1] - 1])
        while len(tail):
            size[tail] -= 1
            tail = tail[space[at[row[tail]] + size[tail] - 1]]
        easy = plain[at[row]] & (size <= MAX_PIECE)
        ids, count = self.merges.encode(lower, at[row[easy]], size[easy])
        if easy.all():
            return np.searchsorted(at, offsets), codes, ids, count
        hard = [self.full.encode(lower[at[r] : at[r] + z].tobytes().decode(), add_special_tokens=False).ids for r, z in zip(row[~easy], size[~easy], strict=True)]
        sizes = np.empty(len(table), np.int64)
        sizes[easy], sizes[~easy] = count, [len(h) for h in hard]
        flat = np.empty(int(sizes.sum()), np.int64)
        where = np.repeat(easy, sizes)
        flat[where], flat[~where] = ids, np.array([i for h in hard for i in h], np.int64)
        return np.searchsorted(at, offsets), codes, flat, sizes

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        first, codes, _, sizes = self._distinct(texts)
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        return total[first[1:]] - total[first[:-1]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as little-endian uint32, and the n+1 offsets between texts;
        ``end_id`` closes each text."""
        first, codes, flat, sizes = self._distinct(texts)
        flat = flat.astype("<u4")
        at = np.cumsum(sizes) - sizes
        each = sizes[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(at[codes] - total[:-1], each) + np.arange(total[-1])] if total[-1] else np.zeros(0, "<u4")
        offsets = total[first]
        if end_id is not None:
            n = len(offsets) - 1
            shift = np.arange(n + 1)
            out = np.full(len(ids) + n, end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[offsets[1:] + shift[:-1]] = False
            out[keep] = ids
            ids, offsets = out, offsets + shift
        return ids, offsets


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
