"""Token ids of whole texts, in Arrow batches."""

from __future__ import annotations

import os
import re
from array import array

#: White space as the byte-level pattern has it, and letters and numbers of Latin, up to LAST.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _NUMBERS, LAST = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\u024f"
#: The byte-level pattern for texts of Latin alone; alternatives that no text can take both of are in order of use.
_PIECE = re.compile(f" ?[{_LETTERS}]+|'(?:[sdmt]|ll|ve|re)| ?[{_NUMBERS}]+| ?[^{_WS}{_LETTERS}{_NUMBERS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_OTHER = re.compile(f"[^\0-{LAST}]")
#: Cuts any text only where the byte-level pattern cuts it too: before a blank and word, around runs of white space.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Strings that a worker remembers: two generations of so many.
CACHE = 200_000
_encoders: dict[str | None, Encoder] = {}


class _Remembered(dict):
    """Ids of strings, made by `make` where they aren't remembered: the last CACHE ones or more, twice as many at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; a piece is merged once as long as it is remembered.

    The library's own cutting of a text costs several times its merging, so Latin texts are cut here, by the
    vocabulary's public pattern, and merged by the library; all others are cut into chunks that are left to the
    library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.merge = self.whole.model.tokenize
        if hasattr(self.whole.model, "_resize_cache"):
            self.whole.model._resize_cache(0)  # pieces are remembered here
        self.cuts = "ByteLevel" in str(self.whole.pre_tokenizer)
        # the printable stand-ins of bytes in a byte-level vocabulary
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.blank = self.stand_in[32]
        self.pieces = _Remembered(self._piece)
        self.chunks = _Remembered(self.alone)

    def alone(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            known = piece.replace(" ", self.blank)
        else:
            known = piece.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.merge(known)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, piece, chunk = [], self.pieces.__getitem__, self.chunks.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif any(s in text for s in self.special):  # these are looked for before a text is cut
                out.append(self.alone(text))
            elif self.cuts and not _OTHER.search(text):
                out.append(b"".join(map(piece, _PIECE.findall(text))))
            else:
                out.append(b"".join(map(chunk, _CHUNK.findall(text))))
        return out


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder; path: a tokenizer file that every executor has (None: the public byte-level one)."""
    if path not in _encoders:
        import public_tokenizers

        _encoders[path] = Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _encoders[path]
