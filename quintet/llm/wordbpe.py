"""Whole-text encoding with a word-level BPE file of the tokenizers library, by remembered words.

The tokenizer drops white space and never merges across it, so a text's ids
are the ids of its space-separated words in order. Each Python worker keeps
the ids of words it has met, packed as little-endian integers, and asks the
library only for new ones. Its memory is bounded by bytes: words of over `LONG`
bytes aren't kept, and of the others two generations of half of `most_bytes`
each are kept, the older one being dropped when the younger is full; words that
are met again move to the younger. Texts that hold "<|" go to the library whole,
since lower-casing them first could make a special token. tests/llm compare
with whole-text encoding.
"""

from __future__ import annotations

import sys
from array import array

import regex

from quintet.llm import common

#: Words of more bytes aren't remembered.
LONG = 48
#: Bytes that an entry of the store takes besides its word: two objects and a place in a dict.
ENTRY = 170
#: Bytes that the byte-level alphabet shows as another character: those that don't print, from 256 on.
HIDDEN = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)]
SHOWN = {c: 256 + i for i, c in enumerate(HIDDEN)}
#: Fixed by the tokenizer file: the pieces that its splitter leaves of a lower-cased word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters alone are split here: printing ones below U+0250, which are composed, no white space
#: and lower-cased one by one, but for the capital I with a dot, of which a mark is left.
PLAIN = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")


def lowered(text: bytes) -> list[bytes]:
    """Its words with A-Z lower-cased, but for words with marks of U+0300 to U+037F.

    The library composes before it lower-cases, and a small letter may compose
    with a mark where the capital does not.
    """
    if b"\xcc" in text or b"\xcd" in text:
        return [w if b"\xcc" in w or b"\xcd" in w else w.translate(common.LOWER) for w in text.split()]
    return text.translate(common.LOWER).split()


class Store(dict):
    """Packed ids by word; a word that it lacks is looked up as it is asked for."""

    def __init__(self, bpe: WordBpe, older: dict[bytes, bytes]):
        self.bpe, self.older, self.held = bpe, older, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.bpe.ids_of(word)
        if len(word) <= LONG:
            self[word] = ids
            self.held += len(word) + ENTRY
        return ids


class WordBpe:
    """A tokenizer with a store of words."""

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.size = self.library.get_vocab_size()
        self.width, self.kind = (2, "H") if self.size <= 1 << 16 else (4, "I")
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        """Empty the store."""
        self.known = Store(self, {})

    def pack(self, ids) -> bytes:
        import numpy as np

        return np.asarray(ids, f"<u{self.width}").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, piece: str) -> bytes:
        ids = array(self.kind, [t.id for t in self.merge(piece)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids_of(self, word: bytes) -> bytes:
        """The library's ids of one word: plain words go piece by piece straight to its merges."""
        if word.isalpha():  # ASCII letters, lower-cased
            return self.merged(word.decode())
        if word[:-1].isalpha() and word[-1:] in (b".", b","):
            return self.known[word[:-1]] + self.known[word[-1:]]
        text = word.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text):
            return self.whole([text])[0]
        pieces = PIECES.findall(text.lower())
        if len(pieces) == 1:
            return self.merged(pieces[0].encode().decode("latin-1").translate(SHOWN))
        return b"".join([self.known[x.encode()] for x in pieces])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids, packed `width` bytes each; null is as empty."""
        out, ids = [], self.known.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif b"<|" in text:
                out.append(self.whole([text.decode("utf-8", "replace")])[0])
            else:
                out.append(b"".join(map(ids, lowered(text))))
        if self.known.held > self.most_bytes // 2:
            self.known = Store(self, dict(self.known))
        return out


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One for each worker and file, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
