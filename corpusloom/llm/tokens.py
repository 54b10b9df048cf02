"""Token ids with the tokenizers library, at the speed of a dictionary.

For both vocabularies of the library's files, a token ends before a blank or line feed with no other white space beside
it (or a second line feed): a byte-level pre-token starts there, and a word-end vocabulary drops white space. So a text
is cut there. The ids of a piece are kept in a bounded table as the bytes of unsigned 32-bit little-endian integers;
those of a new piece are put together from its pre-tokens, whose ids come from the library's own model. The model is
asked once for a word that the table holds: a piece with punctuation behind its word (or, for a word-end vocabulary, in
capitals) is put together from the word's ids, and only each fourth such piece goes into the table as well. A text with
blanks beside other white space, or a piece with letters beyond the Latin blocks, goes through the library as it is. The
ids are always those that the library gives for the whole text.

A control string of the vocabulary that occurs in a text is what the library's ``encode`` makes of it, a control token;
with ``control_text=True`` it is ordinary text, which is the safe way for texts that users wrote.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from collections.abc import Callable

import regex

#: The pre-token patterns of the two files (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LAST_LATIN = "ɏ"
_BEYOND_LATIN = re.compile(f"[^\\x00-{LAST_LATIN}]").search
#: Bytes of the table of pieces (or of counts) that a worker holds, and about what an entry takes beside key and value.
TABLE_BYTES, COUNT_BYTES, ENTRY_BYTES = 128 << 20, 96 << 20, 100
#: The same for pieces: 30 to 60 bytes in the dictionary, the rest is what the allocator rounds up.
PIECE_ENTRY_BYTES = 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


class _Uncut(Exception):
    """The text has white space around which it cannot be cut."""


class _Memo(dict):
    """A table that computes what it lacks, of at most about ``most_bytes``.

    It has two generations of half the bytes each: when the young one is full it becomes the old one, and what is asked
    for again moves back. So frequent keys stay, whatever the number of rare ones.
    """

    entry = ENTRY_BYTES

    def __init__(self, make: Callable[[str], bytes | int], most_bytes: int, longest: int = 48):
        super().__init__()
        self.make, self.half, self.longest = make, most_bytes // 2, longest
        self.old: dict[str, bytes | int] = {}
        self.held = 0

    def __missing__(self, key: str) -> bytes | int:
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes | int) -> None:
        if len(key) <= self.longest:
            if self.held > self.half:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += sys.getsizeof(key) + sys.getsizeof(value) + self.entry
            self[key] = value


class _Pieces(_Memo):
    """Keeps the key that ``make`` names, if any: of a piece whose word is new that word, which serves its other pieces too."""

    entry = PIECE_ENTRY_BYTES

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is not None:
            self.keep(piece, ids)
            return ids
        ids, key, value = self.make(piece)
        if key:
            self.keep(key, value)
        return ids


class Encoder:
    """Encodes texts to id bytes with the tokenizers file at ``path``.

    ``byte_level``: white space is part of the tokens (else it is dropped and letters are lower-cased first).
    ``control_text``: control strings in a text are ordinary text.
    """

    def __init__(self, path: str, byte_level: bool, control_text: bool = False, table_bytes: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = control_text
        self.controls = () if control_text else tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.letters, self.byte_level = _byte_letters(), byte_level
        self.find = regex.compile(BYTE_LEVEL if byte_level else WORD_LEVEL).findall
        self.model = self.library.model
        self.four = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        latin = "".join(map(chr, range(ord(LAST_LATIN) + 1)))  # some of its lower-case letters lie beyond it
        self.spelled = {c: "".join(self.letters[b] for b in c.encode("utf-8")) for c in latin + latin.lower()}.__getitem__
        self.lead = self.letters[ord(" ")] if byte_level else ""
        self.cores, self.pieces = _Memo(self._core, table_bytes // 8), _Pieces(self._piece, table_bytes)
        self.counts, self.assembled = _Memo(self._pretoken, min(table_bytes, COUNT_BYTES)), 0
        self.token_count = self.counts.__getitem__  # the number of ids of a pre-token

    def whole(self, text: str) -> bytes:
        """Straight from the library."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, token: str) -> bytes:
        letters = token.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.model.tokenize(letters)])

    def _pretoken(self, token: str) -> int:
        return len(self.whole(token) if not token.isascii() and _BEYOND_LATIN(token) else self._core(token)) // 4

    def _word(self, word: str) -> bytes:
        """Of Latin letters (or their lower case) behind a blank; ASCII ones need no table of letters."""
        letters = word if word.isascii() else "".join(map(self.spelled, word))
        return b"".join([self.four[t.id] for t in self.model.tokenize(self.lead + letters)])

    def _piece(self, piece: str) -> tuple[bytes, str, bytes]:
        """Of what stands behind a blank, or of a line feed and what stands behind it: ids, a key to keep (or none), its ids."""
        if piece.isascii() or not _BEYOND_LATIN(piece):
            if piece.isalpha() and (self.byte_level or piece.islower()):
                ids = self._word(piece)
                return ids, piece, ids
            stripped = self._stripped(piece)
            plain = stripped if self.byte_level else stripped.lower()  # what the normaliser does to Latin letters
            word = plain.rstrip(string.punctuation)
            if not word.isalpha():
                ids = b"".join(map(self.cores.__getitem__, self.find(piece if self.byte_level and piece[0] == "\n" else " " + plain)))
                return ids, piece, ids
            end = self.cores[plain[len(word) :]] if len(word) < len(plain) else b""
            if self.byte_level and piece[0] == "\n":  # no blank before the word
                ids = self.cores["\n"] + self.cores[word] + end
                return ids, piece, ids
            known = self.pieces.get(word) or self.pieces.old.get(word)
            if known:  # each fourth is kept: a frequent piece soon is, and rare ones leave room for words
                self.assembled += 1
                return known + end, "" if self.assembled % 4 else piece, known + end
            ids = self._word(word)
            return ids + end, word, ids
        ids = self.whole("\n" + self._stripped(piece) if piece[0] == "\n" else " " + self._stripped(piece))
        return ids, piece, ids

    @staticmethod
    def _stripped(piece: str) -> str:
        word = piece.removeprefix("\n")
        if not piece or word != word.strip():
            raise _Uncut
        return word

    def encode(self, text: str) -> bytes:
        # Of a run of white space all but the last is one token, so longer runs of line feeds stay whole.
        if "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"):
            return self.whole(text)
        if any(c in text for c in self.controls):
            return self.whole(text)
        head, *pieces = text.replace("\n", " \n").split(" ")
        try:
            return b"".join([self.whole(head), *map(self.pieces.__getitem__, pieces)])
        except _Uncut:
            return self.whole(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, byte_level: bool, control_text: bool = False) -> Encoder:
    """One per worker process; a worker that turns to another vocabulary lets the one before go."""
    key = (path, byte_level, control_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
