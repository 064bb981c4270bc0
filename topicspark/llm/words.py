"""Splitting a text into the words that a subword tokenizer works on, and a bounded store of their ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from tokenizers import Tokenizer

# Texts of these characters only are split with a compiled pattern: in Latin-1, letters, numbers and white space are the same
# for every library.  All others go through the tokenizer's own normalizer and splitter.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-\xff]")
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t\n\r\x20\xa0"
_GAP = re.compile(f" [{_S}]")
# The split patterns of the two public vocabularies, for Latin-1.
# Only one kind of alternative can begin at a letter or number, so those come first.
SPACED = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BARE = re.compile(f"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{_S}{_L}{_N}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Packed ids (little-endian unsigned 32 bits) of whole texts.

    A text is cut at its spaces into chunks that are tokenized alone, a chunk into words.  `encode` gives the packed ids of a
    list of words.  At most `limit` short chunks and words are kept; a full store starts again, which costs time only.
    With `spaced` a word holds the space before it; otherwise white space only separates.
    """

    def __init__(self, tokenizer: Tokenizer, encode: Callable[[list[str]], list[bytes]], spaced: bool, lower: bool,
                 limit: int = 400_000, longest: int = 64):
        self.tokenizer, self.encode, self.spaced, self.lower = tokenizer, encode, spaced, lower
        self.pattern = SPACED if spaced else BARE
        self.limit, self.longest = limit, longest
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {k: i.to_bytes(4, "little") for k, i in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._from_char = {c: b for b, c in byte_alphabet().items()}

    def _by_words(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as lists of words; the words not yet known are encoded together."""
        new = list({w for ws in texts for w in ws if w not in self.words})
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = list({w for ws in texts for w in ws})
        found = dict(zip(new, self.encode(new))) if new else {}
        self.words.update((w, x) for w, x in found.items() if len(w) <= self.longest)
        get = lambda w: self.words[w] if w in self.words else found[w]
        return [b"".join(map(get, ws)) for ws in texts]

    def _plain(self, text: str) -> bytes:
        if _OTHER.search(text):
            if self.tokenizer.normalizer:
                text = self.tokenizer.normalizer.normalize_str(text)
            words = [bytes(self._from_char[c] for c in w).decode("utf-8")
                     for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            return self._by_words([words])[0]
        if self.lower:
            text = text.lower()
        if not self.spaced:
            parts, head = text.split(), []
        elif text.endswith(" ") or _GAP.search(text):   # white space after a space: no cut at this space
            return self._by_words([self.pattern.findall(text)])[0]
        else:
            first, *parts = text.split(" ")
            head = self._by_words([self.pattern.findall(first)])
        found = list(map(self.chunks.get, parts))
        if None in found:
            new = list({c for c, x in zip(parts, found) if x is None})
            lead = " " if self.spaced else ""
            fresh = dict(zip(new, self._by_words([self.pattern.findall(lead + c) for c in new])))
            found = [fresh[c] if x is None else x for c, x in zip(parts, found)]
            if len(self.chunks) + len(fresh) > self.limit:
                self.chunks.clear()
            self.chunks.update((c, x) for c, x in fresh.items() if len(c) <= self.longest)
        return b"".join(head + found)

    def packed(self, text: str) -> bytes:
        if self.marks is None or "<|" not in text:
            return self._plain(text)
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.marks.split(text) if p)


def texts_of(column) -> Iterable[str]:
    """Strings of an Arrow column; a missing text is an empty one."""
    return (x or "" for x in column.to_pylist())
