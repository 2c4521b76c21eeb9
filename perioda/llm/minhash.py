"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

1. Each text becomes a set of word-shingle hashes; one permutation (the hash itself) deals them to BINS bins, a bin's least hash
   is its signature, and an empty bin borrows from the bin that a fixed sequence of probes finds first (optimal densification).
2. Documents of equal sets become one node: all that follows sees a group of copies as one row.
3. Bands of ROWS bins are buckets; of buckets with the same nodes one is kept. In a bucket each node is paired with hubs only, the most central nodes: a bucket of m nodes gives at most
   m pairs in the first round and HUBS[r] * m in later ones, whatever m is.
4. Pairs are confirmed on their full sets.
5. Links are merged to components by rounds of stars. A node's component and its buckets stand in one row, which is all that a round
   rewrites. Buckets that hold one component are left out; the others get further hubs, and only
   pairs across components are tried. Hubs only spare work: nodes of buckets that hold several components after the last round are
   joined by prefixes of their sets in a common order, rare shingles first. That leaves out only pairs of one component and pairs that
   sizes or positions rule out exactly; all others are confirmed, so no link within a bucket is lost.
A link of exactly the threshold shares no bucket with a chance of (1 - t**ROWS)**BANDS: under 1e-6 for 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .exact_dedup import repeated_words

BANDS, ROWS = 25, 5
BINS = 128

HUBS = (1, 3)  # of a bucket, round by round; the prefix join finds all that is left
RARITY_BITS = 20  # slots of the shingle counts that order prefixes
FILTER_BITS = 22
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(b)
            _powers.append(np.multiply.accumulate(p))
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of the text's bytes: polynomial over its bytes, by differences of one running sum, then mixed."""
    b = np.frombuffer(data.translate(LOWER), dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(b) + 1)
    run = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[: len(b)], out=run[1:])
    return _mix((run[ends] - run[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's `width`-word shingles; of the whole sequence if it has fewer words; none without words."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(BASE) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    return (_mix(np.arange(1, bins * tries + 1, dtype=np.uint64) * np.uint64(BASE)) % np.uint64(bins)).astype(np.int64).reshape(bins, tries)


PROBES = _probes(BINS)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least hash of each bin; empty bins take the value of the first bin with a hash among their probes."""
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    sig, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    sig[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[PROBES[empty]]
        at = hit.argmax(axis=1)
        source = np.where(hit.any(axis=1), PROBES[empty, at], bins[first[0]])
        sig[empty] = sig[source]
    return sig


def sketches(docs: DataFrame, *, text: str, key: str, width: int) -> DataFrame:
    """(id, n, h1, h2, sig, bands) of each row: set size, the set's identity, a byte of each bin, a hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASE)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n, h1, h2, sigs, bands = [], [], [], [], []
                for t in part.column(1):
                    h = shingles(t.as_py(), width)
                    n.append(len(h))
                    h1.append(int(np.add.reduce(_mix(h))) if len(h) else 0)
                    h2.append(int(np.bitwise_xor.reduce(_mix(h + np.uint64(BASE)))) if len(h) else 0)
                    if not len(h):
                        sigs.append(b"")
                        bands.append(np.zeros(0, dtype=np.int64))
                        continue
                    sig = signature(h)
                    sigs.append((_mix(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                    band = salt.copy()
                    for r in range(ROWS):
                        band = _mix(band * np.uint64(BASE) + sig[r : r + ROWS * BANDS : ROWS][:BANDS])
                    bands.append(band.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, dtype=np.uint64).view(np.int64)), pa.array(np.array(h2, dtype=np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "n", "h1", "h2", "sig", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def distinct_buckets(spread: DataFrame) -> DataFrame:
    """(bucket, node, size) of buckets with several nodes; of buckets that hold the same nodes, one.

    Copies with few changes share most of their bands. Buckets are compared by the number of their nodes and two sums of hashes
    of them, combined on the map side.
    """
    held = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(id, 1))").alias("x"), F.expr("bit_xor(xxhash64(id, 2))").alias("y")).where("size > 1")
    shared = held.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return spread.join(shared, "bucket").select("bucket", F.col("id").alias("node"), "size")


def in_buckets(held: DataFrame) -> DataFrame:
    """(bucket, node, central, comp): a row for each bucket of each node of held (node, central, comp, buckets)."""
    return held.select(F.explode("buckets").alias("bucket"), "node", "central", "comp")


def ends() -> list[Column]:
    """The least and the greatest component of a bucket: they differ where it holds several."""
    return [F.min("comp").alias("__lo"), F.max("comp").alias("__hi")]


def candidate_pairs(held: DataFrame, hubs_of: int, round_: int) -> DataFrame:
    """Distinct (a, b, ca, cb), a < b, of nodes that share a bucket and of which one is a hub there; ca and cb are their components.

    held: (node, central, comp, buckets). Only buckets with several components, and only pairs across them. A hub is the most central node of one of
    `hubs_of` hash classes of a bucket. Central is a node that shares many buckets with many others: of copies with more or fewer
    changes, the least changed. Hubs are combined on the map side; the join back on the bucket is one that AQE may split.
    """
    best, buckets = [], in_buckets(held)
    for k in range(hubs_of):
        own = F.struct("central", (-F.col("node")).alias("n"), "node", "comp")
        best.append(F.max(own if hubs_of == 1 else F.when(F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(hubs_of)) == k, own)).alias(f"h{k}"))
    hubs = buckets.groupBy("bucket").agg(*best, *ends()).where("__lo < __hi")
    hubs = hubs.select("bucket", F.filter(F.array(*[f"h{k}" for k in range(hubs_of)]), lambda h: h.isNotNull()).alias("hubs"))
    met = buckets.join(hubs, "bucket").withColumn("h", F.explode(F.filter("hubs", lambda h: h["comp"] != F.col("comp"))))
    first = F.col("node") < F.col("h.node")
    pick = lambda a, b: F.when(first, a).otherwise(b)
    return met.select(pick(F.col("node"), F.col("h.node")).alias("a"), pick(F.col("h.node"), F.col("node")).alias("b"), pick(F.col("comp"), F.col("h.comp")).alias("ca"), pick(F.col("h.comp"), F.col("comp")).alias("cb")).distinct()


def unfinished(held: DataFrame) -> DataFrame:
    """(id, comp) of the nodes of buckets that hold several components: where only one is left, no pair is tried any more."""
    buckets = in_buckets(held)
    several = buckets.groupBy("bucket").agg(*ends()).where("__lo < __hi").select("bucket")
    return buckets.join(several, "bucket", "left_semi").select(F.col("node").alias("id"), "comp").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """(ca, cb) of the pairs with den * |intersection| >= num * |union| on their full sets (least = num / den)."""
    num, den = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(s.as_buffer(), dtype=np.int64), np.frombuffer(t.as_buffer(), dtype=np.int64)
                n, m = len(x), len(y)
                if den * min(n, m) < num * max(n, m):  # sizes alone rule it out
                    ok.append(False)
                    continue
                both = n + m - len(np.union1d(x, y))
                ok.append(den * both >= num * (n + m - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: sets.select(F.col("id").alias(k), F.col("members").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, *, text: str, key: str, width: int) -> DataFrame:
    """(id, members binary) of the nodes, made from the texts anew: a bitmap of fixed size drops other rows at the scan."""
    slot = f"pmod(xxhash64(id), {1 << FILTER_BITS}L)"
    bitmap = settle(repeated_words(nodes.select(F.expr(slot).alias("__slot")), "__slot", FILTER_BITS), "near-bitmap")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("__slot", F.expr(slot))
    rows = rows.withColumn("__w", F.shiftright("__slot", 6).cast("int")).join(F.broadcast(bitmap), "__w").where("shiftright(__bits, cast(__slot & 63 as int)) & 1L = 1L").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in part.column(1)], pa.binary())], names=["id", "members"])

    made = rows.mapInArrow(run, "id long, members binary")
    return made.join(nodes.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def rarity(sets: DataFrame) -> np.ndarray:
    """Logarithmic class of the number of sets in each slot of shingle hashes: any values give the same links, good ones fewer pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for b in batches:
            for s in b.column(0):
                np.add.at(total, (np.frombuffer(s.as_buffer(), dtype=np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    counts = sets.select("members").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.select("slot", F.least(F.lit(255), 1 + F.floor(F.log2("n") * 8)).cast("short").alias("c")).toArrow()  # a fixed size at most
    out = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
    out[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    return out


def prefixes(sets: DataFrame, least: Fraction) -> DataFrame:
    """(node, comp, n, pos, token) of each (id, comp, members): the least * n rule's prefix of the set, in order of rarity.

    Sets with a similarity of least share a token there: their first common one. Tokens of slots with one set are left out.
    """
    num, den, classes = least.numerator, least.denominator, rarity(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n, pos, toks = [], [], []
                for s in part.column(2):
                    h = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                    c = classes[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                    first = np.lexsort((h, c))[: len(h) + 1 + (-num * len(h) // den)]
                    at = np.flatnonzero(c[first])
                    n.append(len(h))
                    pos.append(at.astype(np.int32))
                    toks.append(h[first[at]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(pos, pa.list_(pa.int32())), pa.array(toks, pa.list_(pa.int64()))], names=["node", "comp", "n", "pos", "tok"])

    made = sets.select("id", "comp", "members").mapInArrow(run, "node long, comp long, n int, pos array<int>, tok array<long>")
    return made.select("node", "comp", "n", F.explode(F.arrays_zip("pos", "tok")).alias("p")).select("node", "comp", "n", F.col("p.pos").alias("pos"), F.col("p.tok").alias("token"))


def prefix_pairs(own: DataFrame, least: Fraction) -> DataFrame:
    """Distinct (a, b, ca, cb), a < b, of all nodes across components that may be linked: every link has its pair here.

    The lesser set x of a pair has its first common token within a shorter prefix, as the other set has no fewer tokens; what follows the
    token in either set bounds what they share. A token's most frequent component never meets itself.
    """
    num, den = least.numerator, least.denominator
    each = own.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = each.groupBy("token").agg(F.max(F.struct("k", "comp"))["comp"].alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    rows = settle(own.join(major, "token").withColumn("major", F.col("comp") == F.col("major")), "near-prefixes")
    short = rows.where(F.col("pos") * F.lit(num + den) <= F.col("n") * F.lit(den - num))
    x = short.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "pos", "major")])
    y = rows.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "n", "pos", "major")])
    may = f"""x_comp <> y_comp and (x_n < y_n or x_n = y_n and x_node < y_node) and {den}L * x_n >= {num}L * y_n
        and {num + den}L * least(x_n - x_pos, y_n - y_pos) >= {num}L * (x_n + y_n)"""
    met = [x.where("not x_major").join(y, "token").where(may), x.where("x_major").join(y.where("not y_major"), "token").where(may)]
    first = F.col("x_node") < F.col("y_node")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return met[0].union(met[1]).select(pick("x_node", "y_node").alias("a"), pick("y_node", "x_node").alias("b"), pick("x_comp", "y_comp").alias("ca"), pick("y_comp", "x_comp").alias("cb")).distinct()


def components(edges: DataFrame, name: str, most: int = 40) -> DataFrame:
    """(node, comp) of the nodes of edges (a, b): comp is the least node reachable.

    Each round every node sends the least of its neighbours and itself to all of them and to itself; edges become stars about the
    least nodes. Rounds are written to shared storage and end when the edges stay as they are.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    seen = None
    for i in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        sent = both.join(least, "a").select("a", "b", "m")
        edges = sent.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = settle(edges, f"{name}-{i}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(heads).groupBy("node").agg(F.min("comp").alias("comp"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: components of documents linked by a Jaccard similarity of at least `least`.

    component_id is the smallest key reachable, kept tells the row of that key. Null or blank texts have no shingles and no link.
    Rows of a null key are linked with nothing (component_id null, kept). Rows that share a key are one document. Equal texts
    are linked. Columns other than key and text are not read. An empty table gives an empty one.
    """
    sketch = settle(sketches(docs, text=text, key=key, width=width), "near-sketches")
    usable = sketch.where("n > 0 and id is not null")
    nodes = settle(usable.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "near-nodes")
    buckets = distinct_buckets(nodes.select("id", F.explode("bands").alias("bucket")))
    held = buckets.groupBy("node").agg(F.sum("size").alias("central"), F.collect_list("bucket").alias("buckets"))  # BANDS buckets at most
    held = settle(held.select("node", "central", F.col("node").alias("comp"), "buckets"), "near-held")
    sets = settle(full_sets(docs, held.select(F.col("node").alias("id")), text=text, key=key, width=width), "near-sets")

    def merge(pairs: DataFrame, r: int) -> bool:
        """Components are merged along the pairs that are links, in held. False without any link."""
        nonlocal held
        links = settle(confirmed(pairs, sets, least).distinct(), f"near-links-{r}")
        if links.isEmpty():
            return False
        moved = components(links, f"near-components-{r}").select(F.col("node").alias("comp"), F.col("comp").alias("__to"))
        held = settle(held.join(moved, "comp", "left").select("node", "central", F.coalesce("__to", "comp").alias("comp"), "buckets"), f"near-held-{r}")
        return True

    for r, hubs_of in enumerate(HUBS):
        if held.isEmpty() or not merge(candidate_pairs(held, hubs_of, r), r) and r:
            break
    unsettled = settle(sets.join(unfinished(held), "id"), "near-unsettled")
    if not unsettled.isEmpty():
        merge(prefix_pairs(prefixes(unsettled, least), least), len(HUBS))
    labels = held.select("node", "comp")
    heads = nodes.select("n", "h1", "h2", F.col("id").alias("node"))
    rows = sketch.join(heads, ["n", "h1", "h2"], "left").join(labels, "node", "left")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "node")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
