"""Token ids by a public tokenizer file, each repeated piece encoded once.

The files' own pre-tokenizer cuts a text into pieces that are encoded
independently of each other. Texts in Latin-1 (where NFC changes nothing and
lower-casing is letter by letter) are cut at exactly these places; other texts
are cut at ASCII white space only, which no piece ever spans. The library
itself encodes every distinct piece, in batches balanced by bytes, and the
results are kept per worker. Pieces in Latin-1 that the pre-tokenizer leaves whole
go many in one text; the ids that end a word tell them apart.
"""

from __future__ import annotations

import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import quiet_tokenizers

#: Bytes of text in one call of the library, and bytes of pieces that a worker keeps.
BATCH_BYTES = 1 << 20
KEPT_BYTES = 24 << 20
#: Pieces in one text for the library.
JOINED = 256
#: Pieces of so many characters are cut further where that is safe.
LONG = 512

_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = " \t-\r\x85\xa0"
#: The pre-tokenizer pattern of the file, written for Latin-1.
_PIECE = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: A piece in Latin-1 that the pattern leaves whole, other characters being no marks here.
_WHOLE = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|(?:(?![{_SPACE}{_LETTERS}{_NUMBERS}])[\x00-\xff])+")
_WORD = re.compile("[^ \t\n\r]+")
#: Between an ideograph or kana and a punctuation mark, which normalisation leaves alone and no token spans.
_IDEOGRAPHS, _MARKS = "\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa", "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c\u300d"
_SAFE = re.compile(f"(?<=[{_IDEOGRAPHS}])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_IDEOGRAPHS}])")


class Pieces(dict):
    """Piece -> ids (as little-endian uint32 bytes) or number of ids."""

    def __init__(self, path: str, lengths_only: bool):
        from tokenizers import Tokenizer

        quiet_tokenizers()
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.lengths_only = lengths_only
        self.kept = 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        #: Of each id: does it end a word? None where the file marks no ends.
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab(False).items() if token.endswith(suffix)]] = True

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, to be encoded one by one."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._words(text)
        if "<" in text and any(s in text for s in self.special):
            return self._words(text)
        return _PIECE.findall(text.lower())

    def _words(self, text: str) -> list[str]:
        words = _WORD.findall(text)
        if max(map(len, words), default=0) < LONG:
            return words
        return [part for w in words for part in (_SAFE.split(w) if len(w) >= LONG and not any(s in w for s in self.special) else (w,))]

    def joined(self, pieces: list[str]) -> bytes:
        """The ids of pieces that are all known, in one."""
        return b"".join(itemgetter(*pieces)(self)) if len(pieces) > 1 else self[pieces[0]] if pieces else b""

    def learn(self, cut_texts: list[list[str]]) -> None:
        """Encode the pieces not seen yet, about ``BATCH_BYTES`` at a time."""
        new: set[str] = set()
        for pieces in cut_texts:
            new.update(pieces)
        if self.kept > KEPT_BYTES:
            self.forget(new)
        waiting, size = [], 0
        for piece in new:
            if piece not in self:
                waiting.append(piece)
                size += len(piece) + 8
                if size >= BATCH_BYTES:
                    self._encode(waiting)
                    waiting, size = [], 0
        self._encode(waiting)

    def forget(self, but: set[str]) -> None:
        """All pieces go but those that are asked again now, which the common ones are."""
        still = {p: self[p] for p in but if p in self}
        self.clear()
        self.update(still)
        self.kept = 150 * len(still) + sum(map(len, still)) + (0 if self.lengths_only else sum(map(len, still.values())))

    def _bytes(self, item: tuple) -> int:
        return 150 + len(item[0]) + (0 if self.lengths_only else len(item[1]))

    def _encode(self, pieces: list[str]) -> None:
        whole, alone = [], []
        for piece in pieces:
            (whole if self.ends is not None and _WHOLE.fullmatch(piece) else alone).append(piece)
        groups = [whole[a : a + JOINED] for a in range(0, len(whole), JOINED)]
        for group, e in zip(groups, self._ids(list(map(" ".join, groups))), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):  # a word whose end has no id
                alone += group
                continue
            ends = ends.tolist()
            self.kept += 150 * len(group) + sum(map(len, group)) + (0 if self.lengths_only else 4 * len(ids))
            if self.lengths_only:
                self.update(zip(group, map(int.__sub__, ends, [0, *ends]), strict=False))
            else:
                data = ids.tobytes()
                self.update(zip(group, [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for piece, e in zip(alone, self._ids(alone), strict=True):
            self[piece] = len(e) if self.lengths_only else np.array(e.ids, "<u4").tobytes()
            self.kept += self._bytes((piece, self[piece]))

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


_OPEN: dict[tuple[str, bool], Pieces] = {}


def pieces_of(path: str, lengths_only: bool) -> Pieces:
    """One per worker process and file, kept between tasks with at most ``KEPT_BYTES`` of pieces."""
    if (path, lengths_only) not in _OPEN:
        _OPEN[path, lengths_only] = Pieces(path, lengths_only)
    return _OPEN[path, lengths_only]


def groups_by_bytes(texts: pa.Array, limit: int = 4 << 20):
    """Slices of a column of strings of about ``limit`` bytes of UTF-8 each."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
