"""Token ids of whole texts by a `tokenizers` vocabulary, with a bounded cache of words.

The word vocabulary splits lower-cased text into pieces and never joins across them, so the ids of a text are those of
its pieces in turn. Pieces of plain Latin text go straight to the library's BPE model; a text with any other character
(combining marks, other scripts, a special token's opening) goes through the library's whole chain unchanged.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
from array import array
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Pieces held by each of the two generations of a worker's cache.
CACHE_PIECES = 220_000

#: Characters outside of these need the library's normalizer; "<|" could open a special token.
UNUSUAL = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")

# The vocabulary's own split of lower-cased text, as its file has it, and for the characters above.
PRETOKEN_OF = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-zß-öø-ÿ0-9]+")


def vocabulary(path: str) -> str:
    """The vocabulary file's text, to be broadcast (its size is that of the file, about 2 MB)."""
    return Path(path).read_text(encoding="utf-8")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """The ids' bytes of each piece; the older generation goes when the younger one is full."""

    def __init__(self, model, width):
        super().__init__()
        self.tokenize, self.width, self.old = model.tokenize, width, {}
        self.code = {2: "H", 4: "I"}[width.itemsize]
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array(self.code, [t.id for t in self.tokenize(written)]).tobytes()
        if len(self) >= CACHE_PIECES:
            self.old = self.copy()
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """encode(text) gives the ids' bytes, little-endian, in the narrowest unsigned width that holds the vocabulary."""

    def __init__(self, vocab: str):
        self.library = Tokenizer.from_str(vocab)
        self.width = np.dtype("<u2") if self.library.get_vocab_size() <= 65536 else np.dtype("<u4")
        head = vocab[: vocab.index('"vocab"')]
        self.by_piece = PRETOKEN_OF in head and '"Lowercase"' in head and sys.byteorder == "little"
        self.pieces = _Pieces(self.library.model, self.width)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or UNUSUAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()
        return b"".join(map(self.pieces.__getitem__, PRETOKEN.findall(text.lower())))


_encoders: dict[str, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    """One encoder for each vocabulary in a process."""
    key = hashlib.sha256(vocab.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(vocab)
    return _encoders[key]


def forget() -> None:
    """Drop this process' encoders and their caches: for steps that follow in the same worker and encode nothing."""
    _encoders.clear()
    gc.collect()
