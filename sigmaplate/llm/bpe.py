"""Exact, cached use of a byte-level BPE tokenizer file of the ``tokenizers`` library.

The library splits a text into pre-tokens with
``'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` and merges bytes inside each of
them only.  None of those alternatives matches white space behind other characters, so a place
where a space follows a character that isn't white space always ends a pre-token, whatever stands
around it.  Pieces between such places can therefore be encoded alone and their ids joined.  That
holds for every text; a text with one of the tokenizer's special strings goes to the library whole.

Pieces seen before come from a cache.  A new one that is a word of letters and ASCII marks behind it is
two pre-tokens, which the library's BPE model encodes; others go through the library's whole encoder.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate

_CHUNK = re.compile(r"\s*\S+|\s+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
#: Entries of about 150 bytes each; more save time where texts hold many different words.
CACHE = 600_000
#: Characters of the texts that are worked on at once.
AT_ONCE = 100_000


#: Neither letters, digits nor white space; an apostrophe can start a pre-token with letters.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level BPE files use."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and (33 <= b <= 126 or b >= 161)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    cache: pieces that a process may hold before it starts afresh.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = cache
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        #: Special strings without white space that take none from their neighbours either, so that breaks stay breaks beside them.
        self.plain_specials = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(map(str.isspace, t.content)) for t in added)
        self.splits = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.splits &= not getattr(self.tokenizer.pre_tokenizer, "add_prefix_space", True)
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.tokenize = self.tokenizer.model.tokenize
        #: Ids, as little-endian unsigned 32-bit bytes, of a space and the key, of which the end is a proven break.
        self.pieces: dict[str, bytes] = {}
        #: The same of pre-tokens without a space.
        self.bare: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return _pack([t.id for t in self.tokenize(self.space + mapped)])

    def _bare(self, word: str) -> bytes:
        if (ids := self.bare.get(word)) is None:
            mapped = word.encode().decode("latin-1").translate(self.alphabet)
            ids = self.bare[word] = _pack([t.id for t in self.tokenize(mapped)])
        return ids

    def _learn(self, new: Iterable[str]) -> None:
        """Put pieces into the cache."""
        rest = []
        for piece in new:
            if piece.isalpha():
                self.pieces[piece] = self._spaced(piece)
            elif (word := piece.rstrip(MARKS)).isalpha():
                self.pieces[piece] = self._spaced(word) + self._bare(piece[len(word) :])
            elif (ids := self._two_lines(piece)) is not None:
                self.pieces[piece] = ids
            else:
                rest.append(piece)
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            self.pieces.update(zip(some, self.library([" " + p for p in some]), strict=True))

    def _two_lines(self, piece: str) -> bytes | None:
        """Ids of a piece of two words with marks behind them and one line break between; else None."""
        above, line_break, below = piece.partition("\n")
        first, second = above.rstrip(MARKS), below.rstrip(MARKS)
        if not (line_break and first.isalpha() and second.isalpha()):
            return None
        tails = [self._bare(w) if w else b"" for w in (above[len(first) :], below[len(second) :])]
        return self._spaced(first) + tails[0] + self._bare(line_break) + self._bare(second) + tails[1]

    def many(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        if len(self.bare) > self.cache:
            self.bare.clear()
        out = [b""] * len(texts)
        firsts: dict[int, str] = {}
        whole: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or any(s in text for s in self.specials):
                whole.append(k)
                continue
            first, *rest = text.split(" ")
            got = list(map(self.pieces.get, rest))
            gaps = [i for i, ids in enumerate(got) if ids is None]
            new = dict.fromkeys(map(rest.__getitem__, gaps))
            if rest and (not first or first[-1].isspace()) or any(not p or p[-1].isspace() for p in new):
                # a run of white space crosses a space, or the text ends in white space
                if _SEPARATOR.search(text):
                    whole.append(k)
                else:
                    out[k] = b"".join(self._chunks(_CHUNK.findall(text)))
                continue
            if new:
                self._learn(new)
                for i in gaps:
                    got[i] = self.pieces[rest[i]]
            out[k] = b"".join(got)
            firsts[k] = first
        for k, ids in zip(firsts, self.library(list(firsts.values())), strict=True):
            out[k] = ids + out[k]
        for k in whole:
            out[k] = self.library([texts[k]])[0]
        return out

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each of a text's chunks, which all start with white space but for the first."""
        pieces = {c[1:] for c in chunks if c[0] == " " and c[1:] and not c[-1].isspace()}
        self._learn(pieces.difference(self.pieces))
        rest = [c for c in chunks if c[1:] not in pieces or c[0] != " "]
        known = dict(zip(rest, self.library(rest), strict=True))
        return (known[c] if c in known else self.pieces[c[1:]] for c in chunks)

    def parts(self, text: str) -> tuple[list[bytes], list[int]]:
        """Ids of a text's pieces in order, and the character at which each starts.

        Every place where a space follows a character that isn't white space starts a piece.
        """
        if not self.splits:
            raise ValueError("no breaks are proven for this tokenizer file")
        if not text:
            return [], []
        if any(s in text for s in self.specials) or _SEPARATOR.search(text):
            return self._library_parts(text)
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        if len(self.bare) > self.cache:
            self.bare.clear()
        first, *rest = text.split(" ")
        got = list(map(self.pieces.get, rest))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        new = dict.fromkeys(map(rest.__getitem__, gaps))
        if rest and (not first or first[-1].isspace()) or any(not p or p[-1].isspace() for p in new):
            chunks = _CHUNK.findall(text)
            return list(self._chunks(chunks)), [0, *accumulate(map(len, chunks[:-1]))]
        if new:
            self._learn(new)
            for i in gaps:
                got[i] = self.pieces[rest[i]]
        starts = [0, *accumulate((len(p) + 1 for p in rest[:-1]), initial=len(first))] if rest else [0]
        return [self.library([first])[0], *got], starts

    def _library_parts(self, text: str) -> tuple[list[bytes], list[int]]:
        if not self.plain_specials and any(s in text for s in self.specials):
            return [self.library([text])[0]], [0]
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        before: dict[int, int] = {}  # characters of several bytes may have several ids with the same offsets
        for k, (lo, _) in enumerate(encoding.offsets):
            before.setdefault(lo, k)
        starts = [0, *(p for p in before if p and text[p] == " " and not text[p - 1].isspace())]
        places = [0, *(before[p] for p in starts[1:]), len(encoding.ids)]
        return [_pack(encoding.ids[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)], starts

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def each(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, text, ids) of each (key, text), with texts of about ``AT_ONCE`` characters at a time."""
        held: list[tuple] = []
        size = 0
        for key, text in rows:
            held.append((key, text or ""))
            size += len(held[-1][1])
            if size >= AT_ONCE or len(held) >= 4096:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, held: list[tuple]) -> Iterator[tuple]:
        for (key, text), ids in zip(held, self.many([t for _, t in held]), strict=True):
            yield key, text, ids


_loaded: dict[tuple, ByteBpe] = {}


def encoder(path: str, cache: int = CACHE) -> ByteBpe:
    """The process's own encoder of a file; Python workers live on over many tasks."""
    if (path, cache) not in _loaded:
        _loaded[path, cache] = ByteBpe(path, cache)
    return _loaded[path, cache]


def drop_encoders() -> None:
    """Forget the process's encoders and their caches."""
    _loaded.clear()
