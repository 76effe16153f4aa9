"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

The distinct pieces of a block of texts lie one after another in one array of symbols.
An inverted index leads from a merge rank (the token that a pair of neighbours makes) to
the places where that pair stands. Ranks are taken in ascending order; each merge looks
only at the two neighbours it touches. No piece is ever scanned again.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each
by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from noticeworks.llm.common import blocks, list_values, lists, texts

#: Encoded pieces that a worker remembers; beyond this it starts anew.
REMEMBERED = 500_000
_SHIFT = 24


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one line per token, base64 of its bytes and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class MergeReplay:
    """Replays the merges of a vocabulary over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << _SHIFT | right] = rank
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        found = [self.ranks.get(piece) for piece in pieces]
        whole = [piece for piece, rank in zip(pieces, found) if rank is None and piece]
        replayed = iter(self._replay(whole))
        out = []
        for piece, rank in zip(pieces, found):
            if rank is not None:
                out.append(rank.to_bytes(4, "little"))
            else:
                out.append(next(replayed) if piece else b"")
        return out

    def _replay(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        size = len(flat)
        after = np.arange(1, size + 1)
        after[ends - 1] = -1
        before = np.arange(-1, size - 1)
        before[ends - lengths] = -1
        first = np.full(size, -1, np.int64)
        first[:-1] = self.byte_pairs[flat[:-1], flat[1:]]
        first[ends - 1] = -1
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[places])) + 1
        index = {int(first[group[0]]): group.tolist() for group in np.split(places, cuts) if len(group)}
        symbol, right, left = self.single[flat].tolist(), after.tolist(), before.tolist()
        pairs, waiting = self.pairs, sorted(index)
        while waiting:
            rank = heapq.heappop(waiting)
            group = index.pop(rank, None)
            if group is None:
                continue
            group.sort()
            for done, place in enumerate(group):
                other = right[place]
                if symbol[place] < 0 or other < 0 or pairs.get(symbol[place] << _SHIFT | symbol[other]) != rank:
                    continue
                beyond = right[other]
                symbol[place], symbol[other], right[place] = rank, -1, beyond
                sooner = False
                if beyond >= 0:
                    left[beyond] = place
                    new = pairs.get(rank << _SHIFT | symbol[beyond])
                    if new is not None:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(waiting, new)
                        index[new].append(place)
                        sooner = new < rank
                near = left[place]
                if near >= 0:
                    new = pairs.get(symbol[near] << _SHIFT | rank)
                    if new is not None:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(waiting, new)
                        index[new].append(near)
                        sooner = sooner or new < rank
                if sooner:
                    # A merge of lower rank has become possible: it goes first.
                    if group[done + 1 :]:
                        index[rank] = group[done + 1 :]
                        heapq.heappush(waiting, rank)
                    break
        ids = np.array(symbol, np.int64)
        kept = ids >= 0
        stops = np.cumsum(kept)[ends - 1] * 4
        packed = ids[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


@cache
def disputed_characters() -> dict[str, str]:
    """For each character class: what the library's engine and the regex module class differently.

    Their Unicode versions differ, so newly assigned letters may be letters to one alone.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([byte]): byte for byte in range(256)}
    found = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs = bytes(probe.encode_ordinary(everything)).decode("utf-8")
        found[kind] = "".join(sorted(set(theirs) ^ set(regex.findall(kind, everything))))
    return found


class Splitter:
    """Splits texts by a pattern as the library's engine does."""

    def __init__(self, pattern: str, disputed: dict[str, str]):
        self.usual = regex.compile(pattern)
        self.rare = set("".join(disputed.values()))
        # Texts in most scripts lie below the first disputed character, which a range tells at once.
        self.above = re.compile(f"[{min(self.rare)}-\U0010ffff]") if self.rare else None
        for kind, characters in disputed.items():
            if characters:
                # Symmetric difference: the module's class with the disputed characters turned over.
                pattern = pattern.replace(kind, f"[{kind}~~[{regex.escape(characters)}]]")
        self.careful = regex.compile(pattern, regex.V1)

    def __call__(self, text: str) -> list[str]:
        if self.above and not text.isascii() and self.above.search(text) and not self.rare.isdisjoint(text):
            return self.careful.findall(text)
        return self.usual.findall(text)


def encode_batches(content: bytes, pattern: str):
    """A function over Arrow batches (doc_id, text) that gives (doc_id, ids)."""
    disputed = disputed_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split, known = MergeReplay(load_ranks(content)), Splitter(pattern, disputed), {}
        for block in blocks(batches, "text"):
            pieces = [split(text.decode("utf-8")) for text in texts(block.column(1))]
            new = list({piece for row in pieces for piece in row if piece not in known})
            known.update(zip(new, replay.encode([piece.encode("utf-8") for piece in new])))
            packed = [b"".join(map(known.__getitem__, row)) for row in pieces]
            values = np.frombuffer(b"".join(packed), "<i4")
            yield pa.record_batch(
                [block.column(0), lists(values, [len(row) // 4 for row in packed])], names=["doc_id", "ids"]
            )
            if len(known) > REMEMBERED:
                known = {}

    return run


def encode(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text, by the ranks in the file `vocabulary`.

    The file has a fixed size (one line per token) and is read by the driver, so the
    executors need no copy of it. `pattern` splits a text before the merges.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    return documents.select("doc_id", "text").mapInArrow(
        encode_batches(content, pattern), "doc_id bigint, ids array<int>"
    )


def decode_ids(ids: np.ndarray, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, content) with the bytes that the ids stand for; null ids give no bytes."""
    with open(vocabulary, "rb") as file:
        content = file.read()

    def run(batches):
        tokens = {rank: token for token, rank in load_ranks(content).items()}
        for batch in batches:
            values, offsets = list_values(batch.column(1))
            rows = [decode_ids(values[a:b], tokens) for a, b in zip(offsets, offsets[1:])]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, content binary")


def round_trip(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and tells what came out by digests.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()

    def digests(batches):
        tokens = {rank: token for token, rank in load_ranks(content).items()}
        for batch in batches:
            values, offsets = list_values(batch.column(1))
            values = values.astype("<u4", copy=False)
            rows = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(row.tobytes()).hexdigest() for row in rows], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(row, tokens)).hexdigest() for row in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode(documents, vocabulary, pattern).mapInArrow(
        digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
