"""Word-level BPE ids of whole texts, through the tokenizers library.

The vocabulary drops white space and never merges across it, so the ids of a text are
the ids of its parts between ASCII white space, one after another. Texts of plain Latin
letters, digits and ASCII signs are split by the vocabulary's own rule here, many at once;
each distinct piece of them goes through the library's model once, and its ids are dealt
out to all places. Of other texts this holds for the plain parts; a part that isn't plain,
or holds a special token's string, goes through the whole library pipeline as it is. A
worker remembers pieces and parts, up to a number of bytes, from one task to the next.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from noticeworks.llm.common import blocks, lists

#: Bytes of pieces, with what Python keeps beside each, that a worker remembers of each of its last two spells.
REMEMBERED = 48 << 20
_BESIDE = 180
#: Texts are split in blocks of about this many bytes.
BLOCK = 2 << 20

#: ASCII white space, ASCII without control characters, and the letters of two Latin blocks but for two that
#: don't keep their length when lower-cased or normalized.
_PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-įıĲ-ňŊ-ſ]*")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: What each byte of a lower-cased plain text is; every byte beyond ASCII is part of a letter.
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0, *range(9, 14), 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = _LETTER
_KIND[[*range(ord("0"), ord("9") + 1)]] = _DIGIT


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = dict(zip(plain, map(chr, plain)))
    for byte in range(256):
        if byte not in letters:
            letters[byte] = chr(256 + len(letters) - len(plain))
    return letters


def pieces(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a piece, in lower-cased plain texts that end in a zero byte each.

    A piece is a run of letters, one digit, a run of signs, or, where a run of signs begins
    with an apostrophe, that and one of the endings s, t, m, d, re, ve, ll.
    """
    kind = _KIND[data]
    begins = kind != _SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero(begins & (data == ord("'")))
    # The text ends in a zero byte, so one byte after the apostrophe exists, and a second one after a letter.
    first = data[quote + 1]
    second = data[np.minimum(quote + 2, len(data) - 1)]
    short = np.isin(first, list(b"stmd"))
    long = (np.isin(first, list(b"rv")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    ending = np.where(short, 2, np.where(long, 3, 0))
    quote, ending = quote[ending > 0], ending[ending > 0]
    begins[quote + 1] = False
    begins[quote + ending] = kind[quote + ending] != _SPACE
    return begins


class Memory(dict):
    """Values that are found by a function when first asked for; what no one asked for during a whole spell is forgotten."""

    def __init__(self, find: Callable[[str | bytes], bytes], size: int):
        self.find, self.size, self.held = find, size, 0
        self.old: dict = {}

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        self[key] = value
        self.held += len(key) + len(value) + _BESIDE
        return value

    def trim(self) -> None:
        """Begins a new spell once this one holds enough."""
        if self.held > self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0


class PartIds:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memory(self._piece, REMEMBERED * 3 // 4)
        self.parts = Memory(self._part, REMEMBERED // 4)

    def _piece(self, piece: bytes) -> bytes:
        mapped = piece.decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(mapped)]).tobytes()

    def _part(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(mark in text for mark in self.special)

    def _plain_texts(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        data = np.frombuffer(("\0".join(texts) + "\0").lower().encode(), np.uint8)
        begins, held = pieces(data), _KIND[data] != _SPACE
        offsets = np.append((np.cumsum(held) - 1)[begins], held.sum()).astype(np.int32)
        count = len(offsets) - 1
        found = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).dictionary_encode()
        known = list(map(self.pieces.__getitem__, found.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        index = found.indices.to_numpy(zero_copy_only=False)
        length = sizes[index]
        stands = np.cumsum(length)
        # Where the ids of each place lie among the known ones, less where they are to stand.
        shift = (np.cumsum(sizes) - sizes)[index] - (stands - length)
        whole = np.frombuffer(b"".join(known), "<u4")[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes()
        ends = (4 * np.append(0, stands)[np.cumsum(begins)[data == 0]]).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def _mixed_texts(self, texts: list[str]) -> list[bytes]:
        """Texts that aren't plain, part by part."""
        rows = [[part.decode() for part in text.encode().split()] for text in texts]
        plain = [part for part in {part for row in rows for part in row} if self._plain(part)]
        ids = dict(zip(plain, self._plain_texts(plain)))
        return [b"".join([ids[part] if part in ids else self.parts[part] for part in row]) for row in rows]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        simple = list(map(self._plain, texts))
        plain = iter(self._plain_texts([text for text, is_plain in zip(texts, simple) if is_plain]))
        mixed = iter(self._mixed_texts([text for text, is_plain in zip(texts, simple) if not is_plain]))
        rows = [next(plain if is_plain else mixed) for is_plain in simple]
        self.pieces.trim()
        self.parts.trim()
        return rows


@lru_cache(maxsize=1)
def part_ids(vocabulary: str) -> PartIds:
    """What this worker knows of a vocabulary."""
    return PartIds(vocabulary)


def encode_rows(vocabulary: str, end_id: int):
    """A function over Arrow batches (doc_id, text): blocks of (doc_id column, ids of each row as bytes).

    `end_id` follows the ids of every document. A null text is empty.
    """
    ending = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        parts = part_ids(vocabulary)
        for block in blocks(batches, "text", BLOCK):
            yield block.column(0), [ids + ending for ids in parts.encode([text or "" for text in block.column(1).to_pylist()])]

    return run


def id_lists(rows: list[bytes]) -> pa.ListArray:
    return lists(np.frombuffer(b"".join(rows), "<i4"), [len(row) // 4 for row in rows])


def read_vocabulary(path: str) -> str:
    """The vocabulary file as text: of fixed size, read by the driver and handed to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()
