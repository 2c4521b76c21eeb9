"""Content-addressed store of token ids.

Documents are encoded where they lie, then dealt by blocks of neighbouring ids, one shuffle of packed ids. A rolling hash cuts each
document's ids into chunks where its low bits are all set, so equal passages are cut alike. A block's task writes its ids to a
staging file and returns chunk digests. From the digests alone the block that owns each chunk, the least that has it, is
found. Each block's pack then gets the chunks that it owns, once; its recipe lists each document's chunks, own or foreign, with
the Merkle root over their digests, and ends in the root over all documents. Reading rebuilds documents from recipes and packs and checks
every chunk digest and root. Files are written under a temporary name and renamed when whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import MEET_RE2, unpack
from .common import file_system, new_folder, remove_folder, settle, with_blocks

WINDOW, MEAN_BITS, LEAST, MOST = 16, 9, 64, 4096  # ids: of the rolling hash, log2 of the mean chunk, bounds of a chunk
ROWS_PER_BLOCK = 2048
REMEMBERED, ENTRY = 128 << 20, 220  # bytes of kept pieces in a Python worker; of each besides its characters and ids, about
LINES = 10_000  # of a text that is made of pieces
SEGMENT = 1 << 16  # bytes of a pack that are compressed together, about
BATCH_BYTES = 16 << 20  # of text that are encoded at once
DIGEST = 16
MAGIC = b"IDPACK01"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library's ids of a text as packed little-endian integers of `width` bytes.

    Pieces between spaces repeat, so their ids are kept, REMEMBERED bytes and those of a batch at most in each Python worker, and looked up.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.limit = f"<u{self.width}", remembered
        self.added = pa.scalar("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"\x00")
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.spaces = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)  # tokens with a space: byte-level vocabularies write it so
        self.spaces[[i for t, i in self.tokenizer.get_vocab().items() if "\u0120" in t]] = True
        self.forget()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def forget(self) -> None:
        self.slots: dict[str, int] = {}  # of a key: where its first id and their number are kept, and how often batches have met it
        self.first, self.count, self.met = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.blob, self.used, self.held = np.zeros(1 << 14, self.kind), 0, 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ended(self, keys_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of the ends of documents."""
        return np.array([int(k[2:]) for k in keys_], self.kind), np.arange(len(keys_)), np.ones(len(keys_), np.int64)

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, first, count) of each word after a space: encoded side by side, as only a word's first token holds a space."""
        ids = np.concatenate(self.ids([" " + " ".join(words[i : i + LINES]) for i in range(0, len(words), LINES)]))
        first = np.flatnonzero(self.spaces[ids])
        return (ids, first, np.diff(first, append=len(ids))) if len(first) == len(words) else None

    def lined(self, keys_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, first, count) of keys that begin a text or a line: encoded as lines of one text. A line end is a token of its own there; a
        key that begins with a line end takes the one before."""
        starts = np.array([k[0] == "\n" for k in keys_])
        lines = [k[2:] if k[0] == "\n" else k[1:] for k in keys_]
        found = self.ids(["\n" + "\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)])
        ids = np.concatenate([*found, np.array([self.newline], self.kind)])
        ends = np.flatnonzero(ids == self.newline)
        return (ids, ends[:-1] + ~starts, np.diff(ends) - ~starts) if len(ends) == len(keys_) + 1 else None

    def alone(self, keys_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of any keys, each encoded on its own."""
        parts = [unpack(k) for k in keys_]
        made = iter(self.ids([p for x in parts for p in x]))
        each = [np.concatenate([next(made) for _ in x]) for x in parts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate(each), np.cumsum(sizes) - sizes, sizes

    def learn(self, keys_: list[str]) -> None:
        """Keep the ids of keys that are not kept yet."""
        words, heads, ends, other = [], [], [], []
        for k in keys_:
            if k[:2] == "\0\0":
                ends.append(k)
            elif k and k[0] > " " and not k[-1].isspace():
                words.append(k)
            elif self.newline is not None and k and not k[-1].isspace() and (k[:2] == "\n\0" and len(k) > 2 or k[0] == "\0" and len(k) > 1 and not k[1].isspace()):
                heads.append(k)
            else:
                other.append(k)
        groups = [(names, *(how(names) or self.alone(names))) for names, how in ((words, self.spaced), (heads, self.lined), (ends, self.ended), (other, self.alone)) if names]
        for names, ids, first, count in groups:
            n, m = len(self.slots), len(self.slots) + len(names)
            self.blob = _grown(self.blob, self.used, len(ids))
            self.blob[self.used : self.used + len(ids)] = ids
            self.first, self.count, self.met = _grown(self.first, n, len(names)), _grown(self.count, n, len(names)), _grown(self.met, n, len(names))
            self.first[n:m], self.count[n:m], self.met[n:m] = first + self.used, count, 0
            self.used += len(ids)
            self.slots.update(zip(names, range(n, m)))
            self.held += len(names) * ENTRY + sum(map(len, names)) + ids.nbytes

    def prune(self) -> None:
        """Drop what fewest batches have met, until half of the limit is free; of what as many have met, the later."""
        n = len(self.slots)
        met, keys_, old = self.met[:n], list(self.slots), self.blob
        order = np.argsort(-met, kind="stable")
        sizes = ENTRY + np.fromiter(map(len, keys_), np.int64, n)[order] + self.count[order] * self.blob.itemsize
        kept = np.sort(order[: np.searchsorted(np.cumsum(sizes), self.limit // 2, "right")])
        names = [keys_[i] for i in kept.tolist()]
        count, first, met = self.count[kept], self.first[kept], np.maximum(met[kept] // 2, 1)
        at = np.cumsum(count) - count
        ids = old[np.repeat(first - at, count) + np.arange(int(count.sum()))]
        self.forget()
        if names:
            self.blob, self.used, self.held = ids, len(ids), ENTRY * len(names) + sum(map(len, names)) + ids.nbytes
            self.slots = dict(zip(names, range(len(names))))
            self.first, self.count, self.met = at, count, met

    def places(self, keys_: list[str]) -> np.ndarray:
        """Slots of distinct keys. When what is kept grows past the limit, what few batches have met is dropped first."""
        if self.held > self.limit:
            self.prune()
        found = list(map(self.slots.get, keys_))
        new = [k for k, s in zip(keys_, found) if s is None]
        if new:
            self.learn(new)
            found = list(map(self.slots.__getitem__, keys_))
        at = np.array(found, dtype=np.int64)
        self.met[at] += 1
        return at

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """Packed ids of each text (null: empty) with the end id. Texts are cut into pieces, the last stands for the end. Distinct pieces are
        looked up once, and their packed ids are put in a row; texts in which white space meets, or that hold an added token, are encoded whole."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, MEET_RE2), pc.match_substring_regex(texts, self.added.as_py())))
        plain, found = texts.filter(pa.array(~odd)), pa.array([], pa.large_binary())
        if n := len(plain):
            begin, last, between = (pa.scalar(x, pa.large_string()) for x in ("\0", f" \0\0{end}", ""))
            whole = pc.binary_join_element_wise(begin, plain, last, between)
            cut = pc.split_pattern(pc.replace_substring(whole, "\n", " \n\0"), " ")
            words = cut.flatten().dictionary_encode()
            slots = self.places(words.dictionary.to_pylist())
            each = self.count[slots]
            upto = np.concatenate(([0], np.cumsum(each)))
            ids = self.blob[np.repeat(self.first[slots] - upto[:-1], each) + np.arange(upto[-1])]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(slots), [None, pa.py_buffer(upto * self.width), pa.py_buffer(ids)]).take(words.indices)
            places = np.frombuffer(pieces.buffers()[1], np.int64)
            ends = places[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
            found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pieces.buffers()[2]])
        if odd.any():
            tail = end.to_bytes(self.width, "little")
            whole = pa.array([x.tobytes() + tail for x in self.ids(texts.filter(pa.array(odd)).to_pylist())], pa.large_binary())
            place = np.where(odd, n + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
            found = pa.concat_arrays([found, whole]).take(pa.array(place))
        return found.cast(pa.binary())


def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """array with room for `more` items after the first `used`."""
    if used + more <= len(array):
        return array
    out = np.zeros(max(2 * len(array), used + more), array.dtype)
    out[:used] = array[:used]
    return out


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Ends (1 + position) where the rolling hash of the last WINDOW ids has its low bits set."""
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    rolling = np.zeros(len(ids), dtype=np.uint32)
    for j in range(WINDOW):
        rolling[j:] += mixed[: max(0, len(ids) - j)] << np.uint32(j)
    rolling *= np.uint32(2246822519)
    return np.flatnonzero(rolling >> np.uint32(32 - MEAN_BITS) == 0) + 1


def cut_points(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at marks, LEAST ids or more from the last end, MOST at most. The first LEAST ids hold none, so
    marks may be made over many documents in a row: a window that reaches into the one before is never used."""
    ends, last = [], 0
    for e in marks:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves: pairs are hashed level by level, an odd last one moves up; no leaf: the hash of nothing."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


def put(folder: str, name: str, data: bytes) -> None:
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(data)
    fs.move(temp, f"{base}/{name}")


def get(folder: str, name: str) -> bytes:
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()


def exists(folder: str, name: str) -> bool:
    fs, base = file_system(folder)
    return fs.get_file_info(f"{base}/{name}").type == pafs.FileType.File


def remove(folder: str, name: str) -> None:
    fs, base = file_system(folder)
    fs.delete_file(f"{base}/{name}")


def pack_name(block: int, kind: str) -> str:
    return f"block-{block:010d}.{kind}"


def encode_rows(docs: DataFrame, tokenizer: str, *, text: str, key: str, end_id: int) -> DataFrame:
    """(__key, __tie, __block, ids binary, width) of each row, ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(3)), 0)))
            lo = 0
            while lo < b.num_rows:  # pieces of bounded size, whatever the batch holds
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], encoder.encode(part.column(3), end_id)], names=["__key", "__tie", "__block", "ids"])
                lo = hi

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.xxhash64(body).alias("__tie"), body.alias("__text"))
    rows = with_blocks(rows, "__key", "__tie", ROWS_PER_BLOCK).select("__key", "__tie", "__block", "__text")
    return rows.mapInArrow(run, "__key long, __tie long, __block long, ids binary")


def write_store(docs: DataFrame, folder: str, tokenizer: str, *, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Store of the documents in `folder`; returns its manifest (block, docs, ids, root), settled.

    Order: ascending key, null keys first, ties by the text's hash. Null text is empty: its only id is the end id. Repeated rows are
    documents of their own whose chunks are stored once. Other columns are not read. An empty table writes nothing.
    """
    width = Encoder.of(tokenizer).width

    def stage(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__key", "__tie"], na_position="first", kind="stable")
        block = int(pdf["__block"].iloc[0])
        marks, lengths, counts = [], [], []
        body = b"".join(pdf["ids"])
        upto = np.cumsum([0, *map(len, pdf["ids"])]) // width
        found = rolling_marks(np.frombuffer(body, dtype=f"<u{width}"))
        within = np.searchsorted(found, upto, "right")
        for lo, hi, a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), within[:-1].tolist(), within[1:].tolist()):
            last, n = 0, 0
            for e in cut_points(hi - lo, (found[a:b] - lo).tolist()):
                marks.append(digest(body[(lo + last) * width : (lo + e) * width]))
                lengths.append(e - last)
                last, n = e, n + 1
            counts.append(n)
        keys_ = [None if pd.isna(k) else int(k) for k in pdf["__key"]]
        body = zstandard.compress(body, 1)
        table = struct.pack("<QQ", len(counts), len(lengths)) + b"".join(struct.pack("<?q", k is None, k or 0) for k in keys_)
        table += np.asarray(counts, "<u4").tobytes() + np.asarray(lengths, "<u4").tobytes() + b"".join(marks)
        put(f"{folder}/staging", pack_name(block, "ids"), struct.pack("<Q", len(table)) + table + body)
        return pd.DataFrame({"block": block, "mark": list(dict.fromkeys(marks))})

    def pack(key_: tuple, own: pd.DataFrame, foreign: pd.DataFrame) -> pd.DataFrame:
        block = int(key_[0])
        owner = dict(zip(foreign["mark"].map(bytes), foreign["owner"].astype(int)))
        if not exists(f"{folder}/staging", pack_name(block, "ids")):  # a task that ran before has done it all
            done = list(recipes(folder, block))
            return pd.DataFrame({"block": [block], "docs": [len(done)], "ids": [sum(n for _, n, _, _ in done)], "root": [merkle([r for _, _, r, _ in done]).hex()]})
        raw = get(f"{folder}/staging", pack_name(block, "ids"))
        (size,) = struct.unpack_from("<Q", raw)
        n, m = struct.unpack_from("<QQ", raw, 8)
        at = 24 + 9 * n
        heads = raw[24:at]
        counts = np.frombuffer(raw, "<u4", n, at)
        lengths = np.frombuffer(raw, "<u4", m, at + 4 * n)
        at += 4 * (n + m)
        marks = [raw[i : i + DIGEST] for i in range(at, at + DIGEST * m, DIGEST)]
        body = zstandard.decompress(raw[8 + size :], max_output_size=int(lengths.sum()) * width)
        data, kept, position, where = [], {}, 0, 0
        for mark, length in zip(marks, (lengths * width).tolist()):
            if mark not in owner and mark not in kept:
                kept[mark] = (where, length)
                data.append(body[position : position + length])
                where += length
            position += length
        put(folder, pack_name(block, "pack"), packed_file(width, kept, b"".join(data)))
        roots, i, lines, first = [], 0, [], np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        for d, c in enumerate(counts.tolist()):
            own_marks = marks[i : i + c]
            roots.append(merkle(own_marks))
            lines.append(heads[9 * d : 9 * d + 9] + struct.pack("<QI", int(first[i + c] - first[i]), c) + roots[-1] + b"".join([k + struct.pack("<q", owner.get(k, block)) for k in own_marks]))
            i += c
        put(folder, pack_name(block, "recipe"), MAGIC + struct.pack("<Q", n) + b"".join(lines) + merkle(roots))
        remove(f"{folder}/staging", pack_name(block, "ids"))
        return pd.DataFrame({"block": [block], "docs": [n], "ids": [int(lengths.sum())], "root": [merkle(roots).hex()]})

    spark = docs.sparkSession
    rows = encode_rows(docs, tokenizer, text=text, key=key, end_id=end_id)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = settle(rows.repartition(parts, "__block").groupBy("__block").applyInPandas(stage, "block long, mark binary"), "store-marks")
    owners = marks.groupBy("mark").agg(F.min("block").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    foreign = settle(marks.join(owners, "mark").where("block <> owner").select("block", "mark", "owner"), "store-foreign")
    blocks = marks.select("block").distinct().repartition(parts, "block")
    done = settle(blocks.groupBy("block").cogroup(foreign.repartition(parts, "block").groupBy("block")).applyInPandas(pack, "block long, docs long, ids long, root string"), "store-manifest")
    remove_folder(spark, f"{folder}/staging")
    return done


def packed_file(width: int, kept: dict[bytes, tuple[int, int]], data: bytes) -> bytes:
    """Pack: head, chunk index (digest, first byte, bytes; in order of the digests), segment table (first byte of data, first byte of file), segments."""
    ends, squeeze = [0], zstandard.ZstdCompressor(level=3)
    for a, n in kept.values():
        if a + n - ends[-1] >= SEGMENT:
            ends.append(a + n)
    if ends[-1] < len(data):
        ends.append(len(data))
    segments = [squeeze.compress(data[a:b]) for a, b in zip(ends, ends[1:])]
    index = b"".join([k + struct.pack("<QI", *v) for k, v in sorted(kept.items())])
    starts = np.cumsum([0, *map(len, segments)])
    table = struct.pack("<Q", len(ends)) + b"".join(struct.pack("<QQ", int(a), int(b)) for a, b in zip(ends, starts))
    return MAGIC + struct.pack("<BQQ", width, len(index), len(table)) + index + table + b"".join(segments)


class Pack:
    """Index of a pack, searched as it lies; a chunk is read by decompressing its segment (chunks never cross segments)."""

    def __init__(self, folder: str, block: int) -> None:
        fs, base = file_system(folder)
        self.file = fs.open_input_file(f"{base}/{pack_name(block, 'pack')}")
        size = len(MAGIC) + 17
        head = self.file.read_at(size, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"block {block}: not a pack")
        self.width, n, m = struct.unpack_from("<BQQ", head, len(MAGIC))
        rest = self.file.read_at(n + m, size)
        self.start, self.index = size + n + m, rest[:n]
        (k,) = struct.unpack_from("<Q", rest, n)
        pairs = struct.unpack_from(f"<{2 * k}Q", rest, n + 8)
        self.ends, self.files = pairs[::2], pairs[1::2]
        self.last: tuple[int, bytes] = (-1, b"")
        self.tool = zstandard.ZstdDecompressor()

    def segment(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.file.read_at(self.files[k + 1] - self.files[k], self.start + self.files[k])
            self.last = (k, self.tool.decompress(raw, max_output_size=self.ends[k + 1] - self.ends[k]))
        return self.last[1]

    def chunk(self, mark: bytes) -> bytes:
        step = DIGEST + 12
        i = step * bisect_left(range(len(self.index) // step), mark, key=lambda i: self.index[step * i : step * i + DIGEST])
        if self.index[i : i + DIGEST] != mark:
            raise ValueError(f"chunk {mark.hex()} is not in its pack")
        where, length = struct.unpack_from("<QI", self.index, i + DIGEST)
        k = bisect_right(self.ends, where) - 1
        data = self.segment(k)[where - self.ends[k] : where - self.ends[k] + length]
        if digest(data) != mark:
            raise ValueError(f"chunk {mark.hex()} is damaged")
        return data


def recipes(folder: str, block: int) -> Iterator[tuple[int | None, int, bytes, list[tuple[bytes, int]]]]:
    """(key, ids, root, [(mark, block of its pack)]) of each document; checks the roots up to the block's."""
    raw = get(folder, pack_name(block, "recipe"))
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError(f"block {block}: not a recipe")
    (n,), at, roots = struct.unpack_from("<Q", raw, len(MAGIC)), len(MAGIC) + 8, []
    for _ in range(n):
        null, k, ids, c = struct.unpack_from("<?qQI", raw, at)
        root = raw[at + 21 : at + 21 + DIGEST]
        at += 21 + DIGEST
        chunks = [(raw[i : i + DIGEST], *struct.unpack_from("<q", raw, i + DIGEST)) for i in range(at, at + c * (DIGEST + 8), DIGEST + 8)]
        at += c * (DIGEST + 8)
        if merkle([m for m, _ in chunks]) != root:
            raise ValueError(f"block {block}: a document's chunks don't fit its root")
        roots.append(root)
        yield None if null else k, ids, root, chunks
    if merkle(roots) != raw[at:]:
        raise ValueError(f"block {block}: documents don't fit the root")


def read_store(manifest: DataFrame, folder: str, *, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids if asked for) of every document, rebuilt from the files."""
    before = F.sum("ids").over(W.partitionBy("__all").orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row for each block: 524,288 at most
    parts = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    todo = manifest.withColumn("__all", F.lit(0)).select("block", F.coalesce(before, F.lit(0)).alias("start")).repartition(parts, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, packs = Pack(folder, block), {}
                rows: list[tuple] = []
                for k, n, _, chunks in recipes(folder, block):
                    data = b"".join([(own if o == block else packs.get(o) or packs.setdefault(o, Pack(folder, o))).chunk(m) for m, o in chunks])
                    found = np.frombuffer(data, f"<u{own.width}").astype("<u4")
                    if len(found) != n:
                        raise ValueError(f"block {block}: {len(found)} ids, {n} expected")
                    rows.append((k, start, n, zlib.crc32(found.tobytes()), found.tolist() if ids else None))
                    start += n
                    if len(packs) > 64:
                        packs.clear()
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                upto = 5 if ids else 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:upto], kinds)], names=names[:upto])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, **names) -> DataFrame:
    folder = folder or new_folder(spark, "token-store")
    return read_store(write_store(docs, folder, tokenizer, **names), folder)
