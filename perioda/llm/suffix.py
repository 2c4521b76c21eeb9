"""Suffix-array dedup of repeated byte strings, by deep-shallow sorting.

Sorting every suffix of a corpus is needless: a string of SPAN bytes can only repeat where its anchor repeats. The anchor of a string
is the least hash among its KMER-byte substrings (the leftmost in ties), so equal strings have equal anchors at equal places, and
about one position in thirty is an anchor.
1. Anchors' hashes are counted (map-side combined); those met twice or more go into a bitmap of fixed size on shared storage.
2. Anchors on the bitmap are dealt by hash with the bytes of the strings they stand for. A task sends equal bytes once (the earliest): a
   group of copies shrinks to a row for each task. Anchors of very frequent hashes are dealt string by string, each by its own hash, so no
   task gathers all surroundings of a common passage.
3. A task sorts the suffixes that start at its anchors: a multikey quicksort, eight bytes a key, to the depth SHALLOW, then blind tries for
   the groups that still share all of it. The bytes before the anchors are sorted likewise, read backwards. Both give the length of the
   common prefix of neighbours, so for each offset of the anchor the classes of equal strings follow, and all but the earliest repeat.
4. Repeated strings become byte ranges of documents, merged per document; documents without one never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_folder, settle
from .exact_dedup import repeated_words
from .minhash import _mix, _power_tables

SPAN, KMER = 100, 40
OFFSETS = SPAN - KMER + 1
SHALLOW = 7  # keys of eight bytes
SEGMENT = 1 << 22  # bytes of a document that are scanned at once
FILTER_BITS = 26
ROW_FILTER_BITS = 22
REMEMBERED = 100_000  # strings that a task remembers to send once
ROWS_PER_TASK = 60_000
FREQUENT, MOST_FREQUENT = 50_000, 2_000_000  # rows of a hash from which its strings are dealt one by one; bound of such hashes
ROW = "hash long, doc long, start long, last long, anchor long, bytes binary"


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, first, last): positions of the anchors of the strings of SPAN bytes in data, and the starts they stand for."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    up, down = _power_tables(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=run[1:])
    h = (run[KMER:] - run[:-KMER]) * up[: n - KMER + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    m, w = len(h), OFFSETS
    key = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[:m] = (h & ~np.uint64((1 << 23) - 1)) | np.arange(m, dtype=np.uint64)
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = m - w + 1
    least = np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts])
    at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [starts - 1]))
    return at[first], _mix(h[at[first]]), first, last  # mixed, as least hashes are small numbers: slots and partitions want even ones


def segments(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer(data, dtype=np.uint8)
    for lo in range(0, max(1, len(whole)), SEGMENT):
        yield lo, whole[lo : lo + SEGMENT + SPAN - 1]


@lru_cache(maxsize=2)
def _bitmap(path: str, bits: int) -> np.ndarray:
    """Bitmap written as rows (word, bits), as an array of words."""
    fs, base = file_system(path)
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                rows = pq.read_table(file)
            words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return words


@lru_cache(maxsize=2)
def _values(path: str) -> np.ndarray:
    fs, base = file_system(path)
    out = [np.zeros(0, dtype=np.int64)]
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                out.append(pq.read_table(file).column(0).to_numpy())
    return np.sort(np.concatenate(out))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class BlindTrie:
    """Trie of strings of one length that keeps only branching depths and bytes; a leaf lists the strings that are equal."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.root = texts, None
        for i in range(len(texts)):
            self.insert(i)

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        text, node = self.texts[i], self.root
        while type(node) is tuple:  # down by branching bytes alone, whatever lies between
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        depth = common_prefix(text, self.texts[node[0]])
        if depth == len(text):
            node.append(i)
            return
        above, node = None, self.root
        while type(node) is tuple and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if type(node) is tuple and node[0] == depth:
            node[1][text[depth]] = [i]
            return
        old = node
        while type(old) is tuple:
            old = next(iter(old[1].values()))
        fork = (depth, {self.texts[old[0]][depth]: node, text[depth]: [i]})
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; the first has -1."""
        length, pending, shared = len(self.texts[0]), [(self.root, -1)], -1
        while pending:
            node, before = pending.pop()
            if type(node) is tuple:
                branches = sorted(node[1].items(), reverse=True)
                pending += [(child, node[0]) for _, child in branches[:-1]]
                pending.append((branches[-1][1], before))
            else:
                shared = before
                for i in node:
                    yield i, shared
                    shared = length


def deep_shallow(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows (bytes, width a multiple of 8) sorted within groups, and the common prefix of each with the one before, in the
    order; -1 where the group changes."""
    n, width = rows.shape
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    shallow = min(SHALLOW, width // 8)
    order = np.argsort(groups, kind="stable")
    shared = np.full(n, shallow * 8, dtype=np.int64)
    sorted_groups = groups[order]
    shared[0] = -1
    shared[1:][sorted_groups[1:] != sorted_groups[:-1]] = -1
    part = np.cumsum(shared < shallow * 8)
    for level in range(shallow):  # a multikey quicksort's levels: only parts that are still equal are ordered by the next key
        sizes = np.bincount(part)
        open_ = np.flatnonzero(sizes[part] > 1)
        if not len(open_):
            break
        sub = order[open_]
        key = keys[sub, level]
        by = np.lexsort((key, part[open_]))
        order[open_] = sub[by]
        key = key[by]
        split = np.flatnonzero((part[open_][1:] == part[open_][:-1]) & (key[1:] != key[:-1])) + 1
        if len(split):
            a, b = keys[order[open_[split]], level], keys[order[open_[split - 1]], level]
            x = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
            shared[open_[split]] = level * 8 + x.argmax(axis=1)
            part = np.cumsum(shared < shallow * 8)
    if width > shallow * 8:
        tail = np.ascontiguousarray(rows[:, shallow * 8 :])
        edges = np.flatnonzero(shared < shallow * 8)
        ends = np.concatenate((edges[1:], [n]))
        for lo, hi in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist()):
            own = order[lo:hi].copy()
            texts = [tail[i].tobytes() for i in own]
            for k, (i, s) in enumerate(BlindTrie(texts).walk(), lo):
                order[k] = own[i]
                if k > lo:
                    shared[k] = shallow * 8 + s
    return order, shared


def repeated(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to): byte ranges of the rows' strings that are equal to an earlier string of the rows (all strings of an anchor's
    hash must be among them)."""
    n = len(doc)
    rank = np.lexsort((anchor, doc))
    hashes, doc, start, last, anchor = hashes[rank], doc[rank], start[rank], last[rank], anchor[rank]
    ahead = np.zeros((n, SPAN + 4), dtype=np.uint8)
    behind = np.zeros((n, 64), dtype=np.uint8)
    for i, r in enumerate(rank.tolist()):
        b, a = data[r], int(anchor[i] - start[i])
        x = np.frombuffer(b, dtype=np.uint8)
        ahead[i, : len(x) - a] = x[a:]
        behind[i, :a] = x[:a][::-1]
    _, groups = np.unique(hashes, return_inverse=True)
    right, right_shared = deep_shallow(ahead, groups)
    left, left_shared = deep_shallow(behind, groups)
    low, high = anchor - last, anchor - start
    again = np.zeros((n, OFFSETS + 1), dtype=bool)
    for o in range(OFFSETS):
        on = np.flatnonzero((low <= o) & (o <= high))
        if len(on) < 2:
            continue
        a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        a[right] = np.cumsum(right_shared < SPAN - o)
        b[left] = np.cumsum(left_shared < o)
        _, firsts = np.unique(a[on] * (n + 1) + b[on], return_index=True)
        repeats = np.ones(len(on), dtype=bool)
        repeats[firsts] = False
        again[on[repeats], o] = True
    # a row's earliest copy may be the same place dealt twice: equal (doc, string) is not earlier
    step = np.diff(np.concatenate((np.zeros((n, 1), dtype=bool), again), axis=1).astype(np.int8), axis=1)
    r0, o0 = np.nonzero(step == 1)
    r1, o1 = np.nonzero(step == -1)
    return doc[r0], anchor[r0] - (o1 - 1), anchor[r0] - o0 + SPAN


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _hash_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                found = [anchors(x)[1] for t in b.column(1).slice(lo, 500) for _, x in segments((t.as_py() or "").encode())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["hash"])

    return rows.mapInArrow(run, "hash long")


def _anchor_rows(rows: DataFrame, bitmap: str, bits: int, hot: str) -> DataFrame:
    """ROW rows: anchors that may repeat, or (bytes empty) ranges start..last found to repeat within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common = _bitmap(bitmap, bits), _values(hot)
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        out: list[tuple] = []

        def send(h: int, doc: int, first: int, last: int, at: int, text: bytes, spans: list) -> None:
            mark = (at - first, text)
            known = seen.get(mark)
            if known is not None and known < (doc, first):
                spans.append((first, last + SPAN))
                return
            if known is None and len(seen) > REMEMBERED:
                seen.clear()
            if known != (doc, first):
                seen[mark] = (doc, first)
            out.append((h, doc, first, last, at, text))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 5 + (pa.binary(),))], names=["hash", "doc", "start", "last", "anchor", "bytes"])
            out.clear()
            return made

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                data, spans = (t.as_py() or "").encode(), []
                for lo, x in segments(data):
                    at, h, first, last = anchors(x)
                    slot = _slots(h, bits)
                    on = np.flatnonzero((words[slot >> 6] >> (slot & 63)) & 1)
                    signed = h[on].view(np.int64)
                    frequent = np.isin(signed, common)
                    for k, f, s, e, p in zip(signed.tolist(), frequent.tolist(), (first[on] + lo).tolist(), (last[on] + lo).tolist(), (at[on] + lo).tolist()):
                        if not f:
                            send(k, doc, s, e, p, data[s : e + SPAN], spans)
                            continue
                        for one in range(s, e + 1):
                            text = data[one : one + SPAN]
                            key = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                            send(key, doc, one, one, p, text, spans)
                out += [(hash((doc, s)), doc, s, e, 0, b"") for s, e in merged(spans)]
                if len(out) >= 5000:
                    yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(run, ROW)


def _range_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        h, doc, start, last, anchor = (t.column(i).to_numpy() for i in range(5))
        data = t.column(5).to_pylist()
        plain = np.array([not x for x in data])
        found = [(doc[plain], start[plain], last[plain])]
        rest = np.flatnonzero(~plain)
        if len(rest) > 1:
            found.append(repeated(h[rest], doc[rest], start[rest], last[rest], anchor[rest], [data[i] for i in rest]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "a", "b"])

    return rows.mapInArrow(run, "id long, a long, b long")


def repeated_ranges(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, a, b): byte ranges, perhaps overlapping, that SPAN-byte strings cover which also start earlier; settled.

    Null keys count as one document before all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text).alias("text"))
    counts = settle(_hash_rows(rows).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "span-hashes")
    totals = counts.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    hot, bitmap = new_folder(spark, "span-hot"), new_folder(spark, "span-bitmap")
    counts.where(F.col("n") > max(FREQUENT, totals // MOST_FREQUENT)).select("hash").write.parquet(hot)
    repeated_words(counts.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("__slot")), "__slot", FILTER_BITS).write.parquet(bitmap)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals // ROWS_PER_TASK))
    found = _range_rows(_anchor_rows(rows, bitmap, FILTER_BITS, hot).repartition(parts, "hash"))
    return settle(found, "span-ranges")


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' key with n_bytes, spans (array of struct a, b: the maximal removed byte ranges) and kept (binary: what stays).

    Null text is empty and loses nothing, nor do texts under SPAN bytes. Rows that share a key count as one document: equal rows
    don't repeat each other. Null keys come before all others. Other columns are not read. An empty table gives an empty one.
    """
    ranges = repeated_ranges(docs, text=text, key=key)
    spark = docs.sparkSession
    lists = ranges.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    slot = f"pmod(xxhash64(id), {1 << ROW_FILTER_BITS}L)"
    bitmap = settle(repeated_words(ranges.select("id").distinct().select(F.expr(slot).alias("__slot")), "__slot", ROW_FILTER_BITS), "span-rows")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("__slot", F.expr(slot)).withColumn("__w", F.shiftright("__slot", 6).cast("int")).join(F.broadcast(bitmap), "__w", "left")
    hit = F.expr("coalesce(shiftright(__bits, cast(__slot & 63 as int)) & 1L, 0L) = 1L")
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    still = rows.where(~hit).select("key", F.octet_length("body").cast("long").alias("n_bytes"), empty.alias("spans"), F.col("body").alias("kept"))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, sizes = [], [], []
            for body, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = merged([(r["a"], min(r["b"], len(body))) for r in found or () if r["a"] < len(body)])
                cut = [0, *[x for s in own for x in s], len(body)]
                kept.append(b"".join(body[cut[i] : cut[i + 1]] for i in range(0, len(cut), 2)))
                spans.append([{"a": x, "b": y} for x, y in own])
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    moved = rows.where(hit).join(lists, "id", "left").select("key", "body", "ranges")
    moved = moved.mapInArrow(run, f"key {kind}, n_bytes long, spans array<struct<a:bigint,b:bigint>>, kept binary")
    return still.unionByName(moved).withColumnRenamed("key", key)
