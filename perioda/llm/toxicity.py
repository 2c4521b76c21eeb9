"""Toxicity by compression distance.

Two zstandard dictionaries share a base of ordinary words. zstandard trains the rest: of the toxic one on the words of toxic documents
that begin with a piece of text which those hold far more often than others, of the ordinary one on the words of ordinary documents
that begin like such words. A window, a word in a fixed frame that both dictionaries
know, is compressed with each. The pair (bytes that the toxic dictionary saves, bytes that it still needs) is the window's class: a word that
is known whole differs from one that only begins alike. Classes depend on the word alone, so each Python worker remembers them.
Calibration, on labelled documents that the dictionaries have not seen, gives each class its evidence, the logarithm of the ratio of
its rates per window in toxic and in other documents, the threshold from which evidence counts, and the probability of a
document's summed evidence (its logarithm, as windows of a document are alike). Where a class of
documents is sampled, its documents count for as many as they stand for: scores follow the corpus's share of toxic documents.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

MAX_LABELLED = 12_000  # documents of each class, about: the fit's bound
FRAME = b" the quick frame of a window "
MARK = b"\x01\x01\x01"  # before a word that stands for its class; with MATCH, a match needs the mark and three bytes
MATCH = 6
BASE_BYTES, MAX_PIECES = 6_000, 600
SPECIAL_BYTES, LIKE_BYTES = 5_500, 3_000  # with the base under 16 KB: zstandard misses matches in larger ones at these settings
STEMS = range(4, 10)
LIKE = 2000
TRAIN_K, TRAIN_D = 64, 8  # of zstandard's training: bytes of a segment and of what is counted
EVIDENCE, LIFT, LEAST = 15.0, 15.0, 5  # of a piece: log-likelihood ratio, frequency ratio, toxic documents
SLOT_BITS = 22
REMEMBERED, LONGEST_KEPT = 200_000, 64  # words, and bytes of one, that a worker keeps
WINDOW_LOG = 17  # of zstandard: the whole dictionary is within reach
MOST_SAVED, MOST_NEEDED = 10, 8  # bytes from which classes are one
PRIOR, SURE = 1.0, 30.0  # windows that stand for what isn't seen; log odds of certainty
THRESHOLDS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0)  # of a class's evidence
EDGES = ".,;:!?|\"'()[]#$%&*"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _pieces(text: str, stems: bool) -> set[str]:
    """Words of a text, and with stems each start of a word (a stem ends in '*')."""
    own = set()
    for w in set(tokens(text)):
        w = w.strip(EDGES)
        own.add(w)
        if stems:
            own.update([w[:k] + "*" for k in STEMS if len(w) > k])
    return own


def _frequencies(texts: list[str], least: int, stems: bool) -> Counter:
    """Documents for each piece that stands in `least` of them or more. Slots of a table of fixed size are counted first, so that the many
    rare pieces take no memory."""
    slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
    mask = len(slots) - 1
    for t in texts:
        own = _pieces(t, stems)
        np.add.at(slots, np.fromiter([hash(w) & mask for w in own], np.int64, len(own)), 1)
    often = (slots >= least).tobytes()
    seen: Counter = Counter()
    for t in texts:
        seen.update([w for w in _pieces(t, stems) if often[hash(w) & mask]])
    return Counter({w: n for w, n in seen.items() if n >= least})


def _among(texts: list[str], pieces: Counter) -> Counter:
    """Documents for each of the given pieces."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(_pieces(t, True) & pieces.keys())
    return seen


def _evidence(x: int, n: int, y: int, m: int) -> float:
    """Log-likelihood ratio of x of n against y of m; 0 unless the first is the more frequent."""
    if not n or not m or x / n <= y / m:
        return 0.0
    p = (x + y) / (n + m)
    return 2 * sum(k * math.log(k / (size * p)) for k, size in ((x, n), (y, m)) if k)


class Distance:
    """Class of a word: (bytes that the toxic dictionary saves against the ordinary one, bytes that it needs beyond a known word)."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.squeeze = []
        for content in (toxic, ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(9, source_size=128, dict_size=len(content), window_log=WINDOW_LOG, min_match=MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            held.precompute_compress(compression_params=how)
            self.squeeze.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress)
        self.least = len(self.squeeze[0](FRAME))

    def of(self, word: str) -> tuple[int, int]:
        d = self.known.get(word)
        if d is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            window = FRAME + MARK + word.strip(EDGES).encode() + b" "
            a, b = len(self.squeeze[0](window)), len(self.squeeze[1](window))
            d = (max(-MOST_SAVED, min(b - a, MOST_SAVED)), min(a - self.least, MOST_NEEDED))
            if len(word) <= LONGEST_KEPT:
                self.known[word] = d
        return d


def unlike(texts: list[str]) -> list[str]:
    """Texts without (near) copies: one of those that share the least hash of their word triples, by either of two hashes."""
    seen: set = set()
    out = []
    for t in texts:
        w = tokens(t)
        triples = {" ".join(w[i : i + 3]).encode() for i in range(max(1, len(w) - 2))}
        marks = [(salt, min(zlib.crc32(x, salt) for x in triples)) for salt in (1, 2)]
        if not seen.intersection(marks):
            out.append(t)
        seen.update(marks)
    return out


def _marked(words: list[str], most: int) -> bytes:
    """Words behind marks, the first of the list last; as many of the first ones as `most` bytes hold."""
    out, size = [], 0
    for w in words:
        out.append(MARK + w.encode())
        size += len(out[-1])
        if size > most:
            out.pop()
            break
    return b"".join(reversed(out))


def _trained(samples: list[bytes], most: int) -> bytes:
    """Dictionary of at most `most` bytes that zstandard trains on the samples; empty where they are too few for it."""
    try:
        return zstandard.train_dictionary(most, [x for x in samples if len(x) >= TRAIN_D], k=TRAIN_K, d=TRAIN_D).as_bytes()
    except zstandard.ZstdError:
        return b""


def _marked_words(texts: list[str], kept: set[str]) -> list[list[bytes]]:
    """Of each text its distinct words that are in kept, behind marks."""
    return [[MARK + w.encode() for w in sorted(kept.intersection(x.strip(EDGES) for x in tokens(t)))] for t in texts]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries, from documents of each class.

    zstandard trains the toxic one on the words of toxic documents that begin with a piece, and the ordinary one's part about
    such words on the words of ordinary documents that begin alike. Where samples are too few to train on, the words are listed.
    """
    toxic, ordinary = unlike(toxic), unlike(ordinary)
    t, n, m = _frequencies(toxic, LEAST, True), len(toxic), len(ordinary)
    o, common_words = _among(ordinary, t), _frequencies(ordinary, LEAST, False)
    found = [(_evidence(x, n, o[w], m), w) for w, x in t.items() if x >= LEAST and x / n >= LIFT * o[w] / m]
    found = sorted(((e, w) for e, w in found if e >= EVIDENCE), key=lambda x: (-round(math.log(x[0]) * 10), -len(x[1]), x[1]))
    pieces: list[str] = []
    for _, w in found[: 20 * MAX_PIECES]:  # the longest of those with like evidence comes first
        stem = w.rstrip("*")
        if len(pieces) < MAX_PIECES and not any(stem.startswith(p) or p.startswith(stem) for p in pieces):
            pieces.append(stem)
    starts = tuple(pieces)
    whole = {w for w in t if w[-1:] != "*" and w.startswith(starts)}
    special = _trained([x for own in _marked_words(toxic, whole) for x in own], SPECIAL_BYTES) or _marked(pieces, SPECIAL_BYTES)
    near = {p[:3] for p in pieces}
    words = [w for w, _ in sorted(common_words.items(), key=lambda x: (-x[1], x[0]))[:60_000] if w]
    like = [w for w in words if w[:3] in near and not w.startswith(starts)][:LIKE]
    words = [w.encode() for w in words[:20_000]]
    base, rest, size = [], [], 0
    for w in words:
        (base if size < BASE_BYTES else rest).append(w)
        size += len(w) + 1
    filler = (b" ".join(rest) + b" " * len(special))[: len(special)]
    common = b" ".join(reversed(base))
    both = _trained([b" ".join(own) for own in _marked_words(ordinary, set(like))], LIKE_BYTES) or _marked(like, LIKE_BYTES)  # ordinary words that begin like a toxic piece: the ordinary dictionary knows them too
    return common + b" " * (len(both) + 1) + b" " + special + FRAME, common + b" " + filler + b" " + both + b" " + FRAME


def evidence(classes: list[Counter], toxic: list[int]) -> dict[tuple[int, int], float]:
    """Of each class of windows: the log ratio of its rates in toxic and other documents, drawn to 0 where few windows were seen."""
    seen = [Counter(), Counter()]
    for c, y in zip(classes, toxic):
        for k, n in c.items():
            seen[y][k] += n
    size = [sum(c.values()) + 1.0 for c in seen]  # rates are within a class of documents: its weight cancels out
    share = size[1] / (size[0] + size[1])
    return {k: math.log((seen[1][k] + PRIOR * share) / size[1]) - math.log((seen[0][k] + PRIOR * (1 - share)) / size[0]) for k in seen[0] | seen[1]}


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """(log loss, intercept, slope >= 0) of the weighted logistic regression of y on x."""
    rows, beta, ridge = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -SURE, SURE)))
        step = np.linalg.solve((rows * (w * p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    beta[1] = max(0.0, beta[1])
    odds = np.clip(rows @ beta, -SURE, SURE)
    return float(np.sum(w * (np.logaddexp(0, odds) - y * odds))), float(beta[0]), float(beta[1])


def calibrate(distance: Distance, texts: list[str], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> tuple[dict[tuple[int, int], float], tuple[float, float]]:
    """Evidence of the classes of windows that reach the threshold, and (intercept, slope) of the log odds over the damped sum.

    The threshold is the one whose probabilities fit the labels best (log loss). weights: documents that a sampled one of class 0
    and of class 1 stands for.
    """
    classes = [Counter(map(distance.of, tokens(t))) for t in texts]
    y = np.array(toxic or [0], dtype=float)
    w = np.where(y > 0, weights[1], weights[0])
    found, best = evidence(classes, toxic), None
    for least in THRESHOLDS:
        kept = {k: v for k, v in found.items() if v >= least}
        x = np.array([math.log1p(sum(n * kept[k] for k, n in c.items() if k in kept)) for c in classes] or [0.0])
        loss, *line = logistic(x, y, w)
        if best is None or loss < best[0]:
            best = (loss, kept, (line[0], line[1]))
    return best[1], best[2]


def fit_model(texts: list[str], toxic: list[int], sizes: dict[int, int] | None = None) -> bytes:
    """Model from labelled texts: two of three fit the dictionaries, the third calibrates. One class only: its constant score.

    sizes: documents of each class that the texts were drawn from; without it the texts are all.
    """
    third = [i % 3 == 2 for i in range(len(texts))]
    a = [t for t, y, c in zip(texts, toxic, third) if y and not c]
    b = [t for t, y, c in zip(texts, toxic, third) if not y and not c]
    if not a or not b:
        return pickle.dumps((b"", b"", {}, (math.inf if toxic and min(toxic) == 1 else -math.inf, 0.0)))
    first, second = dictionaries(a, b)
    drawn, held = Counter(toxic), [y for y, c in zip(toxic, third) if c]
    stands = [max(1.0, (sizes or drawn).get(y, 0) / drawn[y]) for y in (0, 1)]
    return pickle.dumps((first, second, *calibrate(Distance(first, second), [t for t, c in zip(texts, third) if c], held, (stands[0], stands[1]))))


@lru_cache(maxsize=1)  # each keeps its words
def _loaded(model: bytes) -> tuple[Distance, dict[tuple[int, int], float], tuple[float, float]]:
    first, second, found, line = pickle.loads(model)
    return Distance(first or FRAME, second or FRAME), found, line


def score_text(model: bytes, text: str | None) -> float:
    """Calibrated probability of the text's summed evidence."""
    distance, found, (intercept, slope) = _loaded(model)
    if math.isinf(intercept):  # one class only
        return float(intercept > 0)
    odds = intercept + slope * math.log1p(sum(found.get(k, 0.0) for k in map(distance.of, tokens(text))))
    return 1 / (1 + math.exp(-max(-SURE, min(odds, SURE))))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", usable: Column | None = None, max_labelled: int = MAX_LABELLED) -> bytes:
    """Model from the rows of labels where `usable` holds: about max_labelled documents of each class, drawn by a hash of the key.

    Rows with null key or label are left out, keys with two labels count as toxic if one says so, null text is empty. The sample
    is fitted in one task: its size is bounded, whatever the corpus. Calibration weighs each class by its size over its sample's.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if usable is not None:
        own = own.where(usable)
    own = own.groupBy(F.col(key).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    sizes = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).where("__y in (0, 1)").collect()}
    draw = F.expr("pmod(xxhash64(__id, 17), 1000000L)")
    take = F.lit(False)
    for y, n in sizes.items():
        take = take | ((F.col("__y") == y) & (draw < F.lit(max(1, round(1e6 * min(1.0, max_labelled / n))))))
    chosen = F.broadcast(own.where(take))  # about 2 * max_labelled rows of two numbers at most
    sample = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(chosen, "__id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("__id").sort_values("__id", key=lambda s: (s * 2654435761) % 1000003, kind="stable")
        return pd.DataFrame({"model": [fit_model([t or "" for t in pdf["__text"]], [int(y) for y in pdf["__y"]], sizes)]})

    found = sample.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "model binary").first()
    return bytes(found["model"]) if found else fit_model([], [])


def score(docs: DataFrame, model: bytes, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out` (double, 0 to 1): null and empty texts get the score of a text without windows; rows are scored one by one, so
    repeated rows score alike; an input column of that name is replaced; an empty table gives an empty one."""
    docs = without(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score_text(model, t.as_py()) for t in b.column(b.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)
