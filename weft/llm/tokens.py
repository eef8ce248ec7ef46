"""Words and ids of public tokenizers, with each distinct word encoded once a worker.

Where texts are Latin-1 and the tokenizer cuts words by one of the patterns below, the words are cut in arrays of characters
(whose classes are written out in full below); any other text, one with an added token's string such as <|endoftext|>
(which is that token's id, as in the library's plain call), and every text of a tokenizer with another normalizer, pre-tokenizer
or pattern goes through the library whole. Words go through the library's merges once and are remembered in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from weft.llm import _common

#: Letters, numbers and white space among the Latin-1 characters (fixed values of Unicode).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
SPACES = "\t-\r \x85\xa0"

#: Fixed values of the formats: the pattern of byte-level BPE, and the parts of a tokenizer's file, by kind, that `words` stands for.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUTS = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    "plain": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [{"type": "Split", "pattern": {"Regex": PLAIN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
        },
    },
}

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _of in ((_LETTER, LETTERS), (_NUMBER, NUMBERS), (_SPACE, SPACES)):
    for _c in range(256):
        if re.fullmatch(f"[{_of}]", chr(_c)):
            _CLASS[_c] = _kind
_LOWER = bytes(chr(c).lower().encode("latin-1")[0] for c in range(256))


@dataclass(frozen=True)
class Words:
    """Words of some texts: the distinct ones, each word's place among them, and each text's first word and the end."""

    distinct: list[bytes]
    places: np.ndarray
    first: np.ndarray


def words(raw: list[bytes], spaced: bool) -> Words:
    """Words of Latin-1 texts, as the vocabularies' patterns cut them.

    A pattern's cuts depend on a character and its neighbours only, so all texts are cut at once.
    spaced: byte-level BPE's pattern, in which a space goes with the word after it and other white space
    makes words; else numbers are single and white space only parts words (and is a word here).
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    n, starts = len(data), np.cumsum([0, *map(len, raw)])
    if not n:
        return Words([], np.zeros(0, np.int32), np.zeros(len(starts), np.int64))
    kind = _CLASS[data]
    cut, opens = np.empty(n, bool), np.zeros(n + 3, bool)
    opens[starts] = True
    before, after = kind[:-1], kind[1:]
    np.not_equal(before, after, out=cut[1:])
    if spaced:
        blank = kind == _SPACE
        cut[1:] &= ~(blank[:-1] & ~blank[1:] & (data[:-1] == 32))
        # Of several blanks before a word the last stands alone, for the word or for itself.
        cut[1:-1] |= blank[:-2] & blank[1:-1] & ~blank[2:] & ~opens[2:n]
    else:
        cut[1:] |= (before == _NUMBER) | (after == _NUMBER)
    cut |= opens[:n]
    marks = np.flatnonzero(data == 39)
    if len(marks):
        _contractions(data, kind, cut, opens, marks, spaced)
    bounds = np.append(np.flatnonzero(cut), n)
    found = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    return Words(found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(bounds, starts))


def _contractions(data: np.ndarray, kind: np.ndarray, cut: np.ndarray, opens: np.ndarray, marks: np.ndarray, spaced: bool) -> None:
    """'s 't 'm 'd 're 've 'll are words where the mark begins one."""
    n = len(data)
    ahead = np.append(data, np.zeros(3, np.uint8))
    last = kind[marks - 1]
    begins = opens[marks] | (last == _LETTER) | (last == _NUMBER) | ((last == _SPACE) & ((data[marks - 1] != 32) if spaced else True))
    one, two = ahead[marks + 1], ahead[marks + 2]
    inside = (marks + 1 < n) & ~opens[marks + 1]
    short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = inside & (marks + 2 < n) & ~opens[marks + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for at, size in ((marks[begins & short], 2), (marks[begins & long], 3)):
        cut[at] = True
        for k in range(1, size):
            cut[at + k] = False
        ends = at + size
        cut[ends[ends < n]] = True


#: Bytes of text that are encoded together.
SLICE_BYTES = 4 << 20
#: Words that a worker remembers beside those of the texts at hand; beyond it the cache starts anew.
CACHE_WORDS = 600_000

assert sys.byteorder == "little", "ids are written as little-endian numbers"



def latin1(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


_made: dict[tuple, object] = {}


class Library:
    """Whole texts to ids, exactly as the `tokenizers` library gives them.

    kind "byte": byte-level BPE (GPT-2's pattern); kind "plain": lower case, white space dropped.
    """

    def __init__(self, source: str, kind: str, dtype: str = "<u2") -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tool = Tokenizer.from_str(source)
        parts = json.loads(source)
        #: If `words` cuts as this tokenizer does; else it gets all texts whole.
        self.known = all(parts.get(k) == v for k, v in CUTS[kind].items())
        # Texts that hold an added token's string, in whatever case, go through the library whole.
        added = [re.escape(t.content) for t in self.tool.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.kind, self.dtype = kind, dtype
        self.model, self.words = self.tool.model, {}
        self.code = {1: "B", 2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        # What stands for a character's bytes in the vocabulary, as the library itself writes it.
        write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {k: write(chr(k))[0][0] for k in range(256)}
        self.blanks = {chr(k) for k in np.flatnonzero(_CLASS == _SPACE).tolist()}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _of_words(self, found: list[bytes]) -> list[bytes]:
        if len(self.words) + len(found) > CACHE_WORDS:
            self.words.clear()
        known, merge, letters, code, out = self.words.get, self.model.tokenize, self.letters, self.code, []
        for w in found:
            ids = known(w)
            if ids is None:
                text = w.decode("latin-1")
                ids = b"" if self.kind == "plain" and text[0] in self.blanks else array(code, [t.id for t in merge(text.translate(letters))]).tobytes()
                self.words[w] = ids
            out.append(ids)
        return out

    def ids_of(self, texts: list[str]) -> list[bytes]:
        raw = [None if not self.known or self.added.search(t) else latin1(t) for t in texts]
        found = words([x.translate(_LOWER) if self.kind == "plain" else x for x in raw if x is not None], self.kind == "byte")
        each = self._of_words(found.distinct)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // np.dtype(self.dtype).itemsize
        flat, starts = np.frombuffer(b"".join(each), self.dtype), np.cumsum(sizes) - sizes
        lengths = sizes[found.places]
        ids = flat[_common.ragged(starts[found.places], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[found.first].tolist()
        own = iter([ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)])
        return [self._encode(t) if x is None else next(own) for x, t in zip(raw, texts, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


def widest(source: str, *more: int) -> str:
    """The type that holds every id of a tokenizer's file, and `more`."""
    parts = json.loads(source)
    top = max([*parts["model"]["vocab"].values(), *(t["id"] for t in parts.get("added_tokens", ())), *more])
    return "<u2" if top < 1 << 16 else "<u4"


def library(source: str, kind: str, dtype: str = "<u2") -> Library:
    """One for each worker and tokenizer."""
    key = (hashlib.md5(source.encode()).digest(), kind, dtype)
    if key not in _made:
        _made[key] = Library(source, kind, dtype)
    return _made[key]  # type: ignore[return-value]


class Ranks:
    """Byte-level BPE by a rank file; words by the pattern of that file."""

    def __init__(self, source: str, pattern: str) -> None:
        import regex
        import tiktoken

        ranks = read_ranks(source)
        self.tool = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), pattern == SPACED
        #: Bytes of each id, one after another, with each one's start and length.
        top = max(ranks.values()) + 1
        each = [b""] * top
        for piece, n in ranks.items():
            each[n] = piece
        self.length = np.array([len(x) for x in each], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def split(self, texts: list[str]) -> Words:
        """Words in UTF-8."""
        raw = [latin1(t) if self.known else None for t in texts]
        found = words([x or b"" for x in raw], True)
        distinct = [w if w.isascii() else w.decode("latin-1").encode() for w in found.distinct]
        if not any(x is None for x in raw):
            return Words(distinct, found.places, found.first)
        seen = {w: k for k, w in enumerate(distinct)}
        parts = []
        for k, (x, text) in enumerate(zip(raw, texts, strict=True)):
            own = found.places[found.first[k] : found.first[k + 1]]
            if x is None:
                own = np.array([seen.setdefault(m.group().encode(), len(seen)) for m in self.pattern.finditer(text) if m.group()], np.int32)
            parts.append(own)
        return Words(list(seen), np.concatenate(parts), np.cumsum([0, *map(len, parts)]))

    def encode(self, word: bytes) -> list[int]:
        return self.tool._encode_single_piece(word)


def ranks(source: str, pattern: str) -> Ranks:
    key = (hashlib.md5(source.encode()).digest(), pattern)
    if key not in _made:
        _made[key] = Ranks(source, pattern)
    return _made[key]  # type: ignore[return-value]


def read_ranks(source: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.splitlines() if line)}
