"""Byte-level BPE ids of whole texts, with each distinct word encoded by the tokenizers library.

A text is cut into words at places where the tokenizer's pattern always ends a piece, whatever stands around them: before
white space that follows a visible character, after a single line feed or tab, and between letters, digits and
punctuation. A word keeps the space before it, so that a text's ids are those of its words, one after another, each
encoded as a text of its own. Places are found from pairs of bytes, for many texts at once; where the kind of a character
isn't clear from its bytes, nothing is cut, which leaves a word longer and its ids the same.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps, works_on

#: Entries of a worker's table of words, in two generations: when the younger is full, the older goes.
WORDS_AT_MOST = 400_000
#: Texts are taken together until they have so many bytes, and words that are new until they have so many characters.
GROUP_BYTES, CHUNK = 8 << 20, 4000


def default_vocabulary() -> str:
    """Path of the public 50k byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Kinds of bytes: space, other white space, letter, digit, punctuation, other visible, unclear.
SPACE, WHITE, LETTER, DIGIT, MARK, OTHER, UNCLEAR = range(7)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:32] = _KIND[127] = UNCLEAR
_KIND[32] = SPACE
_KIND[9:14] = WHITE
for _c in range(33, 127):
    # An apostrophe may begin a piece that goes on with letters.
    _KIND[_c] = LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else OTHER if chr(_c) == "'" else MARK
#: First bytes of two-byte characters that are letters but for two, and of all white space beyond ASCII.
_LATIN, _WIDE = np.zeros((2, 256), bool)
_LATIN[[0xC3, 0xC4, 0xC5]] = True
_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_WIDE[[c[0] for c in _SPACES]] = True
_SPACES_BY_SIZE = {n: np.array([int.from_bytes(c, "big") for c in _SPACES if len(c) == n]) for n in (2, 3)}
#: Whether a piece ends between two bytes of such kinds.
_CUT = np.zeros((8, 8), bool)
_CUT[LETTER : OTHER + 1, [SPACE, WHITE]] = True
_CUT[WHITE, LETTER : OTHER + 1] = True
for _a in (LETTER, DIGIT, MARK):
    for _b in (LETTER, DIGIT, MARK):
        _CUT[_a, _b] = _a != _b
_CUT = _CUT.ravel()


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 texts; all bytes of a character are of one kind."""
    kind = _KIND[data]
    latin = np.flatnonzero(_LATIN[data])
    if len(latin):
        pair = data[latin + 1]
        latin = latin[(data[latin] != 0xC3) | (pair != 0x97) & (pair != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
    wide = np.flatnonzero(_WIDE[data])
    for n, known in _SPACES_BY_SIZE.items():
        at = wide[wide + n <= len(data)]
        code = sum(data[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
        for k in range(n):
            kind[at[np.isin(code, known)] + k] = UNCLEAR
    return kind


#: Before a space between two characters other than white space.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


class Words(NamedTuple):
    """Texts as words: the words, where each text's begin (and the last end), whether a word begins with a space between
    two visible characters, and of each word the place of its first id and how many it has."""

    words: pa.Array
    offsets: np.ndarray
    spaced: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the last end)."""
        ends = np.cumsum(self.sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts - (ends - self.sizes), self.sizes) + np.arange(total)
        return self.ids[at], np.concatenate([[0], ends])[self.offsets]


def split(texts: pa.Array, whole: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words, offsets and spaced (see Words) of texts without nulls. whole: special tokens, which are never cut."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    size = int(bounds[-1] - bounds[0]) if len(texts) else 0
    if not size:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64), np.zeros(0, bool)
    raw = raw.slice(int(bounds[0]), size)
    data, bounds = np.frombuffer(raw, np.uint8), bounds - bounds[0]
    kind = kinds(data)
    cut = np.zeros(size + 1, bool)
    cut[1:size] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
    visible = np.append((kind >= LETTER) & (kind <= OTHER), False)
    # White space is a word of its own where it is one character; in a longer run the last one stands apart.
    white = np.flatnonzero(kind == WHITE)
    cut[white[(white == 0) | ~visible[white - 1]] + 1] = False
    cut[bounds] = True
    for token in whole:
        text, at = memoryview(raw).tobytes() if token[:1] else b"", -1
        while (at := text.find(token, at + 1)) >= 0:
            cut[at + 1 : at + len(token)] = False
            cut[bounds[(bounds > at) & (bounds < at + len(token))]] = True
    starts = np.flatnonzero(cut[:size])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size).astype(np.int32)), raw)
    # Where a text begins, there is no character before; its last byte has none after it in the same text.
    spaced = (kind[starts] == SPACE) & visible[starts - 1] & visible[starts + 1]
    offsets = np.searchsorted(starts, bounds)
    edge = np.zeros(len(starts) + 1, bool)
    edge[offsets] = True
    return words, offsets, spaced & ~edge[:-1] & ~(edge[1:] & (np.append(starts[1:], size) - starts == 1))


class Known:
    """A table of words and their ids that holds `most` words and what one call adds; it keeps those used lately."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            absent = []
            for i in missing:
                found[i] = x = self.old.get(words[i])
                if x is None:
                    absent.append(i)
            for i, x in zip(absent, self.encode([words[i] for i in absent]), strict=True):
                found[i] = x
            if len(self.young) + len(missing) > self.most // 2:
                self.old, self.young = self.young, {}
            self.young.update((words[i], found[i]) for i in missing)
        return found


class Encoder:
    """Ids of texts as little-endian 16-bit numbers, with a bounded table of words."""

    def __init__(self, path: str, most: int = WORDS_AT_MOST):
        self.tokenizer = tokenizer(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        set_up = json.loads(self.tokenizer.to_str())
        before = set_up["pre_tokenizer"] or {}
        if set_up["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or any(a.lstrip or a.rstrip or a.single_word for a in special):
            raise ValueError("not a plain byte-level tokenizer")
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.whole = [a.content.encode() for a in special]
        self.lengths = np.array([len(x) for x in pieces(path)])
        self.known = Known(self.each, most)
        self.loose = Known(self.each, most // 4)

    def ids(self, texts: list[str]) -> np.ndarray:
        """Ids of texts, one after another."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, "<u2"), *[np.array(e.ids, "<u2") for e in found]])

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Those that are cut off from one another by their spaces are encoded together."""
        inner = [len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace() for w in words]
        together = [w for w, x in zip(words, inner, strict=True) if x]
        chunks, low, size = [], 0, 0
        for k, n in enumerate(map(len, together), 1):
            size += n
            if size >= CHUNK:
                chunks.append("".join(together[low:k]))
                low, size = k, 0
        chunks.append("".join(together[low:]))
        ids = self.ids(chunks)
        ends = np.cumsum([len(w.encode()) for w in together])
        cuts = (2 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 2).tolist()
        data, at, out = ids.tobytes(), 0, []
        done = iter(cuts)
        for w, x in zip(words, inner, strict=True):
            if x:
                stop = next(done)
                out.append(data[at:stop])
                at = stop
            else:
                out.append(self.ids([w]).tobytes())
        return out

    def encoded(self, texts: pa.Array) -> Words:
        """Texts (null: empty) as words with their ids; each different word is looked up once."""
        words, offsets, spaced = split(texts.fill_null(""), self.whole)
        coded = words.dictionary_encode()
        parts = self.known(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        starts = np.cumsum(sizes) - sizes
        return Words(words, offsets, spaced, np.frombuffer(b"".join(parts), "<u2"), starts[codes], sizes[codes])

    def short(self, text: str) -> tuple[list[str], list[bytes]]:
        """Words of a short text, cut only at spaces between visible characters, and the ids of each."""
        words = _BETWEEN.split(text) if text else []
        return words, self.loose(words)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return self.encoded(pa.array([text], pa.string())).joined()[0]


def grouped(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches, joined until their texts have about `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(text).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One a process."""
    works_on("bpe")
    return _encoder(path)


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens are their text."""
    # The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    t = tokenizer(path)
    special = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    out = []
    for i in range(t.get_vocab_size()):
        piece = t.id_to_token(i)
        out.append(special[i].encode() if i in special else bytes(byte_of[c] for c in piece))
    return out


def _let_go() -> None:
    for kept in (_encoder, tokenizer, pieces):
        kept.cache_clear()


keeps("bpe", _let_go)
