"""Token ids by the `tokenizers` library, with a word cache that cannot change them.

Both vocabularies split a text by a fixed expression before they merge, so a text's ids are its
pieces' ids one after the other. Texts of basic Latin letters (code points under U+0180, where
normal forms, letter classes and lower-casing agree between libraries) are split here and looked up;
any other text, and any that holds the string of an added token, goes to the tokenizer whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: The character classes under U+0180, and the contractions both vocabularies know.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \u0085 "
SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"

OTHER = re.compile("[^\\x00-įı-ſ]|[\\x1c-\\x1f]")
#: A cut of letters alone, which is one piece.
LETTERS = f"\\A[{LETTER}]+\\z"
WORDS = re.compile(f"{SUFFIX}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
BYTES = re.compile(f"{SUFFIX}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Pieces kept in each of two generations: about 70 MB a generation.
KEPT = 350_000


class _Pieces(dict):
    """Piece -> ids as little-endian bytes. When a generation is full it becomes the old one; pieces still in use come back from there."""

    def __init__(self, encode, kept: int) -> None:
        super().__init__()
        self.encode, self.kept, self.old = encode, kept, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Ids:
    """The ids of Tokenizer.from_file(path).encode(text, add_special_tokens=False): the string of an added token is that token."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = self.tokenizer.normalizer is not None
        self.split = (WORDS if self.lower else BYTES).findall
        self.pieces = _Pieces(self._piece, kept)
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.small = self.tokenizer.get_vocab_size() < 1 << 16

    def _piece(self, piece: str) -> bytes:
        """A piece is one word to the model, which needs no more than its merges."""
        if piece.isascii() and piece.isprintable():  # of these only the space is written otherwise
            word = piece.replace(" ", self.letters[0x20])
        else:
            word = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> bytes:
        if OTHER.search(text) or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower() if self.lower else text)))

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self._ids(text), "<u4")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the len + 1 offsets of theirs.

        Texts are cut before single spaces, where no piece of either vocabulary's goes on, and equal
        cuts are encoded once a batch. Byte-level pieces may span two spaces or more, so texts with
        such runs are not cut there, nor are texts that hold the string of an added token. What a cut
        holds is asked of all of a batch's at once, and one of letters alone is looked up as it is.
        """
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        whole = pc.match_substring_regex(texts, "|".join([*map(re.escape, self.added), *([] if self.lower else ["  "])]) or "$.")
        if pc.any(whole).as_py():
            # each of these texts is one cut of its own
            lists = [[t] if w else t.split(" ") for t, w in zip(texts.to_pylist(), whole.to_pylist(), strict=True)]
            cuts = pa.array(lists, pa.large_list(pa.large_string()))
        else:
            cuts = pc.split_pattern(texts, " ")
        first = np.asarray(cuts.offsets).astype(np.int64)
        words = cuts.flatten()
        first = first - first[0]
        coded = words.dictionary_encode()
        kinds = np.asarray(coded.indices)
        other, letters = (pc.match_substring_regex(coded.dictionary, p).to_numpy(zero_copy_only=False) for p in ("|".join([OTHER.pattern, *map(re.escape, self.added)]), LETTERS))
        how = np.where(other, 2, letters)
        if not self.lower and len(kinds):  # all but a text's first cut begin with the space they were cut at
            kinds = kinds * 2 + 1
            kinds[first[:-1]] -= 1
            used, kinds = np.unique(kinds, return_inverse=True)
            names = coded.dictionary.to_pylist()
            names = [(" " if k & 1 else "") + names[k >> 1] for k in used.tolist()]
            how = how[used >> 1]
        else:
            names = coded.dictionary.to_pylist()
        piece, split = self.pieces.__getitem__, self.split
        lower = map(str.lower, names) if self.lower else names
        ids = [piece(low) if h == 1 else self._ids(name) if h else b"".join(map(piece, split(low))) for name, low, h in zip(names, lower, how.tolist(), strict=True)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        pool = np.frombuffer(b"".join(ids), "<u4")
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lens, out=at[1:])
        n = lens[kinds]
        ends = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        take = np.repeat((at[:-1][kinds] - ends[:-1]).astype(np.int32), n)
        take += np.arange(len(take), dtype=np.int32)
        return pool[take], ends[first]


_LOADED: dict[str, Ids] = {}


def loaded(path: str) -> Ids:
    """One per path and Python worker: workers are used again, so the cache stays warm."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
