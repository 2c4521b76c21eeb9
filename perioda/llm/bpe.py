"""Byte-level BPE as a monoid: encodings of halves are joined by re-encoding a growing window around the seam.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours encode to themselves. Inside the two
halves that holds already, so a join has to look at the seam alone: it re-encodes a window of tokens on either side and widens it
until the neighbours at both of its edges encode to themselves; tokens beyond are then final. Decoding concatenates up a tree.
Each match of the splitting pattern is encoded on its own. Documents are rows and are encoded where they lie: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import keys, unpack

LEAF = 4  # bytes that are merged directly
REMEMBERED, LONGEST = 800_000, 64  # pieces in each Python worker, characters of one
_codecs: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder for a file of ranks (lines: base64 of the token's bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.decimal = {i: str(i) for i in self.bytes_of}

    @staticmethod
    def of(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
        if path not in _codecs or _codecs[path].remembered != remembered:
            with open(path, "rb") as lines:
                _codecs[path] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern, remembered)
        return _codecs[path]

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merges by rank, lowest first and leftmost in ties, over a chain of parts with a heap of candidate pairs."""
        n, ranks = len(data), self.ranks
        if n == 1:
            return (ranks[data],)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:  # one of the two has been merged meanwhile
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(data[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if before[i] >= 0 and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(out)

    def small(self, data: bytes) -> tuple[int, ...]:
        """merged(), remembered for short data."""
        known = self.parts.get(data)
        if known is None:
            known = self.merged(data)
            self.remember(data, known)
        return known

    def remember(self, data: bytes, ids: tuple[int, ...]) -> None:
        if len(data) <= 12:
            if len(self.parts) > self.remembered // 2:
                self.parts.clear()
            self.parts[data] = ids

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > self.remembered // 2:
                self.stable.clear()
            known = self.stable[a, b] = self.small(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        if not a or not b or self.neighbours(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.small(b"".join(map(self.bytes_of.__getitem__, a[len(a) - i :] + b[:j])))
            left = i == len(a) or self.neighbours(a[-i - 1], window[0])
            right = j == len(b) or self.neighbours(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def tree(self, data: bytes) -> tuple[int, ...]:
        known = self.parts.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:])) if len(data) > LEAF else self.merged(data) if data else ()
            self.remember(data, known)
        return known

    def word(self, match: str) -> tuple[int, ...]:
        """Ids of a match of the pattern; one that is a token as a whole is that token."""
        data = match.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def piece(self, text: str) -> tuple[int, ...]:
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):  # one match, without looking
            return self.word(text)
        return tuple(t for m in self.find(text) for t in self.word(m))

    def encode(self, text: str) -> list[int]:
        cut = keys(text)
        if cut is None:
            return [t for m in self.find(text) for t in self.word(m)]
        known = self.pieces
        try:
            return list(chain.from_iterable(map(known.__getitem__, cut)))
        except KeyError:
            if len(known) > self.remembered:
                known.clear()
            long: dict[str, tuple[int, ...]] = {}  # of this text alone: what is kept is bounded in bytes too
            for k in cut:
                if k not in known:
                    (known if len(k) <= LONGEST else long)[k] = tuple(t for p in unpack(k) for t in self.piece(p))
            return list(chain.from_iterable([known[k] if k in known else long[k] for k in cut]))

    def decode(self, ids: list[int], block: int = 4096) -> bytes:
        """Bytes of the ids: blocks are concatenated, then neighbours pairwise up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + block])) for i in range(0, len(ids), block)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def encode_documents(docs: DataFrame, *, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs with `ids` (array<int>), and `decoded` (binary, from the ids) if named. Null text counts as empty: no ids.

    Rows stay as they are, repeated or not; input columns of the output names are replaced; an empty table gives an empty one.
    Bytes that are no valid text can't occur, as Spark strings are UTF-8.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern, remembered)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [codec.encode(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = [*part.columns, pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids, *([decoded] if decoded else [])])

    schema = docs.withColumn(ids, F.lit(None).cast("array<int>"))
    if decoded:
        schema = schema.withColumn(decoded, F.lit(None).cast("binary"))
    return docs.mapInArrow(run, schema.schema)


def encoding_digests(docs: DataFrame, *, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: hashes of the decimal ids joined by commas and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for b in batches:
            counts, hashed, back = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py() or "")
                counts.append(len(ids))
                hashed.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(back)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
