"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, name clashes."""

import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perioda.llm import bpe, minhash, suffix, tokenstore, toxicity, warc
from perioda.llm.common import with_blocks
from perioda.llm.exact_dedup import exact_dedup
from perioda.llm.fingerprint import combine, fingerprint_edits, likeness, to_string, with_fingerprint
from perioda.llm.mixing import mix
from perioda.llm.sharding import kd_shards

WORDS = "the of and ing tion er re on an es".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


LONG = prose(4000, 1)
BASE = prose(120, 2)
TEXTS = [None, "", " ", "a", "same", "same", "same", BASE, BASE, BASE.replace("the", "thx", 1), LONG, LONG + " tail", "É\n" + prose(60, 3), "one two", "one two three", "one two three", prose(200, 4) + "\n" + BASE[:300], "x" * 500, "ab" * 200, prose(30, 5)]
ROWS = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# ---- 1 exact dedup


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert rows_of(exact_dedup(docs), "keep_id", "group_size", "kept") == want
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("how", [{"filter_bits": 6}, {"prefix_chars": 1}])
def test_exact_dedup_with_full_filter(docs, how):
    assert rows_of(exact_dedup(docs, **how), "keep_id", "kept") == rows_of(exact_dedup(docs), "keep_id", "kept")


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "y"), (None, "b", "y"), (None, "a", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert got.columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    seen = sorted((str(r["doc_id"]), r["group_size"], r["kept"]) for r in got.collect())
    assert seen == sorted([("1", 3, True), ("1", 3, True), ("None", 2, True), ("None", 2, True), ("None", 3, False)])


# ---- 2 fingerprints


def test_edits(docs, empty):
    order = sorted(ROWS, key=lambda r: -r[0])
    want = {}
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        want[i] = (len(t), t[: len(t) - third] + nxt[:third])
    got = fingerprint_edits(docs)
    assert rows_of(got, "n_chars", "edited") == want
    near = rows_of(got, "near_edited", "near_next")
    assert all(0 <= x <= 1 for v in near.values() for x in v) and near[5][1] == 1.0
    by_text = {}
    for r in got.withColumn("f", to_string(F.col("fp"))).collect():
        by_text.setdefault(TEXTS[r["doc_id"]] or "", set()).add(r["f"])
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert fingerprint_edits(empty).count() == 0


def test_homomorphism(spark):
    a, b = prose(40, 7), prose(50, 8)
    df = spark.createDataFrame([(a, b, f"{a}\n{b}", f"{b}\n{a}")], "a string, b string, ab string, ba string")
    for c in df.columns:
        df = with_fingerprint(df, c, f"f_{c}")
    f = {c: F.col(f"f_{c}") for c in ("a", "b", "ab", "ba")}
    r = df.select((f["ab"] == f["ba"]).alias("order"), (combine(f["a"], f["b"]) == f["ab"]).alias("add"), (combine(f["ab"], f["b"], -1) == f["a"]).alias("take"), likeness(f["ab"], f["ba"]).alias("same")).first()
    assert tuple(r) == (True, True, True, 1.0)


def test_many_sentences(spark):
    many = "x." * 20_000
    # two lines of half as many sentences give the same counts
    halves = "x." * 10_000 + "\n" + "x." * 10_000
    df = with_fingerprint(with_fingerprint(spark.createDataFrame([(many, halves)], "t string, u string"), "t", "a"), "u", "b")
    r = df.first()
    assert r["a"][5:] == r["b"][5:]


def test_blocks_rise_with_keys(spark):
    """Clustered, repeated and null keys: blocks rise with (key, tie) and none holds much more than its share."""
    keys = [i * i for i in range(3000)] + list(range(10**9, 10**9 + 1000)) + [77] * 3000 + [None] * 1000
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").withColumn("t", F.xxhash64("i"))
    rows = with_blocks(df, "k", "t", 20, out="b").orderBy(F.asc_nulls_first("k"), "t").collect()
    blocks = [r["b"] for r in rows]
    assert blocks == sorted(blocks) and len(set(blocks)) > 250
    assert max(blocks.count(b) for b in set(blocks)) < 150
    assert with_blocks(df.limit(0), "k", "t", 20).count() == 0


# ---- 3 mixing


def test_mixing(docs, empty, spark):
    got = mix(docs, keep_share=0.5).collect()
    assert len(got) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in got)
    goal = {"lang": {"en": 0.5, "de": 0.5}}
    targets = {"lang": spark.createDataFrame(list(goal["lang"].items()), "value string, share double")}
    rows = mix(docs, targets=targets).select("source", "lang", "topic", "fitted_share").distinct().collect()
    for lang, share in goal["lang"].items():
        assert sum(r["fitted_share"] for r in rows if r["lang"] == lang) == pytest.approx(share, abs=1e-3)
    again = rows_of(mix(docs), "sampled")
    assert again == rows_of(mix(docs), "sampled") and any(v[0] for v in again.values())
    assert mix(empty).count() == 0


def test_mixing_margins(spark):
    r = random.Random(1)
    rows = [(i, prose(r.randrange(5, 60), i), r.choice(["a", "a", "a", "b"]), r.choice("xyz")) for i in range(400)] + [(400, None, None, "x")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), temper=0.3)
    weight, cells = {}, got.select("source", "lang", "topic", "fitted_share").distinct().collect()
    for x in got.select("source", "n_tokens").collect():
        weight[x["source"]] = weight.get(x["source"], 0) + x["n_tokens"]
    all_ = sum(w**0.3 for w in weight.values())
    for s, w in weight.items():
        assert sum(c["fitted_share"] for c in cells if c["source"] == s) == pytest.approx(w**0.3 / all_, abs=1e-4)


def test_mixing_topic_of_the_whole_text(spark):
    def lines(n, seed):
        return "\n".join(prose(6, seed * 100 + k) for k in range(n))

    texts = ["\n" + prose(30, 1), "a title\n\n" + lines(5, 2), lines(9, 3), prose(3, 4) + "\n" + "again " * 300, "again\tagain\rother", "", None, "to be\nor not"]
    texts += [lines(4, k) for k in range(10, 30)]
    spread = [(i, w) for i, t in enumerate(texts) for w in re.split("[ \n\t\r]", t or "") if len(w) >= 5]
    counts = {}
    for r in spark.createDataFrame(spread, "i int, w string").select("i", F.expr("pmod(xxhash64(w), 8)").alias("c")).groupBy("i", "c").count().collect():
        counts.setdefault(r["i"], []).append((-r["count"], r["c"]))
    want = {i: (f"t{min(counts[i])[1]}" if i in counts else "t0",) for i in range(len(texts))}
    assert rows_of(mix(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "topic") == want


# ---- 4 archives


PAGES = [(1, "http://a/x y", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>same</p>"), (5, "http://c", "é" * 3000), (6, "d", "x\r\n\r\ny\n\nWARC/1.1\r\n")]


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    pages = spark.createDataFrame([(*p, 9) for p in PAGES], "page_id long, url string, html string, extra int")
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark, pages, version=version).collect()}
    groups = {}
    for i, _, h in PAGES:
        groups.setdefault((h or "").encode(), []).append(i)
    want = set()
    for i, _, h in PAGES:
        b = (h or "").encode()
        top = max((x for x in groups[b] if x is not None), default=None)
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == want


def test_archive_payloads_and_limits(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    m = warc.write_arc(pages, f"{folder}/arc", roll_bytes=100)
    files = m.select("file").distinct().count()
    assert files > 2
    done = warc.convert(warc.choose_responses(m, min_bytes=50), f"{folder}/arc", f"{folder}/warc", files)
    rows = warc.read_warc(done, f"{folder}/warc", files, payloads=True).collect()
    assert {r["page_id"]: r["payload"].decode() for r in rows if r["page_id"]} == {i: h or "" for i, _, h in PAGES if i}
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 50) and all(re.fullmatch(r"<urn:uuid:[-0-9a-f]{36}>", r["record_id"]) for r in rows)
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


# ---- 5 repeated strings


def brute_repeats(texts):
    """{key: (bytes, removed, spans, kept)} of texts in key order."""
    seen, out = set(), {}
    for k, t in texts:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - suffix.SPAN + 1):
            w = b[i : i + suffix.SPAN]
            if w in seen:
                mask[i : i + suffix.SPAN] = b"\1" * suffix.SPAN
            seen.add(w)
        out[k] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), bytes(x for x, m in zip(b, mask) if not m))
    return out


def removed(df):
    return {r["doc_id"]: (r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in suffix.remove_repeats(df).collect()}


def test_suffix_dedup(docs, empty):
    assert removed(docs) == brute_repeats([r[:2] for r in ROWS])
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_dedup_overlaps(spark, monkeypatch):
    r = random.Random(5)
    passages = [prose(25, 100 + i) for i in range(6)] + ["z" * 130, "ab" * 90]
    rows = [(i, " ".join(r.choice(passages) if r.random() < 0.5 else prose(r.randrange(1, 12), 1000 + i * 7 + k) for k in range(r.randrange(1, 6)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    assert removed(df) == want
    monkeypatch.setattr(suffix, "FREQUENT", 5)  # frequent anchors are dealt string by string
    monkeypatch.setattr(suffix, "MOST_FREQUENT", 10**9)
    assert removed(df) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=16).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12))
def test_blind_trie_sorts(texts):
    got = list(suffix.BlindTrie(texts).walk())
    assert [texts[i] for i, _ in got] == sorted(texts)
    for (i, _), (j, shared) in zip(got, got[1:]):
        assert shared == next((k for k in range(16) if texts[i][k] != texts[j][k]), 16)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 1000))
def test_deep_shallow_sorts(n, seed):
    r = np.random.default_rng(seed)
    rows = np.repeat(r.integers(0, 2, (n, 8)), 9, axis=1)[:, :72].astype(np.uint8)
    groups = r.integers(0, 3, n)
    order, shared = suffix.deep_shallow(rows, groups)
    keyed = [(groups[i], rows[i].tobytes()) for i in order]
    assert keyed == sorted(keyed)
    for a, b, s in zip(order, order[1:], shared[1:]):
        want = -1 if groups[a] != groups[b] else next((k for k in range(72) if rows[a][k] != rows[b][k]), 72)
        assert s == want


# ---- 6 toxicity


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = prose(r.randrange(20, 80), 5000 + i).split()
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["vilest", "wretch", "scoundrel"]))
        rows.append((i, " ".join(w), i % 7))
        labels.append((i, int(bad)))
    rows += [(900, None, 0), (901, "", 0), (902, LONG, 0)]
    labels += [(900, None), (None, 1), (3, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab, usable=F.col("doc_id") % 3 != 1)
    got = rows_of(toxicity.score(d, model), "score")
    held = [i for i in range(900) if i % 3 == 1]
    assert all((got[i][0] >= 0.7) == (i % 5 == 0) for i in held) and all(0 <= s <= 1 for (s,) in got.values())
    assert got[900] == got[901] and got[902][0] < 0.7
    assert toxicity.score(d.limit(0), model).count() == 0
    nothing = toxicity.fit(d, lab.limit(0))
    assert toxicity.score_text(nothing, "a vilest wretch") == 0.0


def test_toxicity_of_a_sample(spark):
    """Scores follow the share of toxic documents in the corpus, however few of a class are sampled."""
    rows = [(i, prose(30, 9000 + i)) for i in range(3000)]  # nothing tells the classes apart: one in ten is toxic
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "doc_id long, toxic int")
    whole, sampled = (toxicity.score_text(toxicity.fit(d, lab, max_labelled=m), BASE) for m in (12_000, 300))
    assert whole == pytest.approx(0.1, abs=0.05) and sampled == pytest.approx(0.1, abs=0.05)


def test_toxicity_dictionaries_stay_small():
    """However many pieces stand out, the dictionaries stay below the size at which matches get lost, and the first pieces are known."""
    r = random.Random(5)
    bad = ["".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(6)) for _ in range(2000)]
    toxic = [prose(20, i) + " " + " ".join(r.sample(bad[:300], 40) + r.sample(bad, 200)) for i in range(200)]
    first, second = toxicity.dictionaries(toxic, [prose(60, 10_000 + i) for i in range(400)])
    assert max(len(first), len(second)) < 1 << 14
    distance = toxicity.Distance(first, second)
    assert sum(distance.of(w)[0] >= 4 for w in bad[:300]) > 200
    assert not any(distance.of(w)[0] >= 4 for w in prose(200, 77).split())


def test_toxicity_dictionaries_are_trained(monkeypatch):
    """zstandard trains both, on words of either class; samples that are too few give listed words instead, with like classes."""
    r = random.Random(6)
    bad = ["".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(6)) for _ in range(40)]
    alike = [w[:3] + "".join(r.choice("hjqwxy") for _ in range(5)) for w in bad]
    toxic = [prose(20, i) + " " + " ".join(r.sample(bad, 8)) for i in range(300)]
    ordinary = [prose(30, 20_000 + i) + " " + " ".join(r.sample(alike, 8)) for i in range(500)]
    made = {}
    for how in ("trained", "listed"):
        if how == "listed":
            monkeypatch.setattr(toxicity, "_trained", lambda samples, most: b"")
        distance = toxicity.Distance(*toxicity.dictionaries(toxic, ordinary))
        made[how] = [sum(distance.of(w)[0] >= 4 for w in words) for words in (bad, alike)]
    assert all(known >= 38 and other == 0 for known, other in made.values())
    assert toxicity._trained([], 100) == toxicity._trained([b"x"], 100) == b""


# ---- 7 sharding


def test_shards(docs, empty, spark):
    got = kd_shards(docs, shards=4).collect()
    assert len(got) == len(ROWS)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {r["doc_id"]: r["size"] for r in got} == {i: len((t or "").encode()) + 1 for i, t, *_ in ROWS}
    assert kd_shards(empty, shards=4).count() == 0


def test_shard_balance_with_hot_group(spark):
    r = random.Random(2)
    rows = [(i, "hot text" * 20 if i % 3 == 0 else prose(r.randrange(1, 40), i), "s") for i in range(3000)] + [(None, None, None)] * 3
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [x["b"] for x in got]
    assert len(sizes) == 8 and max(sizes) <= 1.05 * min(sizes)
    few = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), target_bytes=sum(sizes) // 3)
    assert few.select("shard").distinct().count() == 4


# ---- 8 token store


def ids_of(texts):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store(docs, empty, spark, tmp_path):
    want, start = {}, 0
    for (i, t, *_), ids in zip(ROWS, ids_of(TEXTS)):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    folder = f"file://{tmp_path}/s"
    manifest = tokenstore.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert rows_of(tokenstore.read_store(manifest, folder, ids=True), "start", "n_tokens", "ids_crc32", "ids") == want
    assert manifest.agg(F.sum("ids")).first()[0] == start
    pack = next(p for p in (tmp_path / "s").iterdir() if p.name.endswith(".pack"))
    pack.write_bytes(pack.read_bytes()[:-3])
    with pytest.raises(Exception):
        tokenstore.read_store(manifest, folder).collect()
    assert tokenstore.store_and_read(spark, empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_store_shares_chunks(spark, tmp_path, monkeypatch):
    rows = [(i, LONG) for i in range(6)]
    monkeypatch.setattr(tokenstore, "ROWS_PER_BLOCK", 2)
    folder = f"file://{tmp_path}/s"
    m = tokenstore.write_store(spark.createDataFrame(rows, "doc_id long, text string"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    packs = sorted((tmp_path / "s").glob("*.pack"), key=lambda p: p.stat().st_size)
    assert len(packs) == 3 and packs[0].stat().st_size < 200 < packs[-1].stat().st_size
    assert len({r["ids_crc32"] for r in tokenstore.read_store(m, folder).collect()}) == 1


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(0, 50_000, 20_000).astype(np.uint16)
    b = np.concatenate((r.integers(0, 50_000, 777).astype(np.uint16), a))
    ends = lambda x: tokenstore.cut_points(len(x), tokenstore.rolling_marks(x).tolist())
    cut = lambda x: {x[i:j].tobytes() for i, j in zip([0, *ends(x)], ends(x))}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 3
    assert ends(np.zeros(9000, np.uint16))[-1] == 9000


def test_token_store_keeps_the_pieces_that_most_batches_met():
    """Too many pieces met twice for what may be kept: the most met stay, and every text is encoded as the library does."""
    encoder = tokenstore.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=1 << 17)
    often, twice = prose(60, 21).split(), [f"w{i}" for i in range(300)]
    batches = [" ".join(often), " ".join(often + twice), " ".join(twice + often), " ".join(f"once{i}" for i in range(400))]
    for text in batches:
        (got,) = encoder.encode(pa.array([text]), 0).to_pylist()
        assert np.frombuffer(got, encoder.kind).tolist() == ids_of([text])[0]
    encoder.prune()
    assert set(often[1:]) <= set(encoder.slots)
    assert 0 < encoder.held <= encoder.limit // 2
    texts = [*batches, None, "", " ", "a b\n", "\nab c", "x" * 300]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(pa.array(texts), 0).to_pylist()] == ids_of(texts)


# ---- 9 near duplicates


def brute_components(rows, width, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if least.denominator * both >= least.numerator * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    comp[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


@pytest.mark.parametrize("width,least", [(5, Fraction(4, 5)), (3, Fraction(85, 100))])
def test_near_duplicates(docs, empty, width, least):
    got = rows_of(minhash.near_duplicates(docs, width=width, least=least), "n_shingles", "component_id", "kept")
    assert got == brute_components([r[:2] for r in ROWS], width, least)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicate_chains(spark):
    r, rows = random.Random(9), []
    for g in range(12):
        w = prose(r.choice([8, 20, 60, 150]), 300 + g).split()
        for _ in range(15):  # each copy changes the one before
            w = list(w)
            if r.random() < 0.8:
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    r.shuffle(rows)
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, least=Fraction(85, 100)), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 3, Fraction(85, 100))


def test_near_duplicate_edits_of_one_template(spark):
    """Edits under the threshold to their template, in pairs over it to each other: no link has a hub of a large bucket."""
    r, base, rows = random.Random(4), prose(600, 77).split(), []
    rows.append((0, " ".join(base)))
    for g in range(150):
        at = r.sample(range(3, 597, 4), 25)
        pair = [list(base), list(base)]
        for k, i in enumerate(at):
            for e, w in enumerate(pair):
                if k < 9 or (k < 17) == (e == 0):  # nine common changes, eight of each one's own
                    w[i] = f"new{g}x{k}"
        rows += [(1 + 2 * g + e, " ".join(w)) for e, w in enumerate(pair)]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, least=Fraction(85, 100)), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 3, Fraction(85, 100))
    assert len({c for _, c, _ in got.values()}) == 151


def test_near_duplicate_components_stand_once_a_node(spark, monkeypatch):
    """Copies that share most of their buckets: what a round rewrites has a row for each node, not for each bucket of each."""
    r, base, rows, written = random.Random(6), prose(300, 78).split(), [], {}
    for g in range(60):
        w = list(base)
        w[r.randrange(300)] = f"new{g}"
        rows.append((g, " ".join(w)))

    def counted(df, name, settle=minhash.settle):
        out = settle(df, name)
        if {"node", "comp"} <= {*out.columns} and "token" not in out.columns:
            written[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "settle", counted)
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, least=Fraction(85, 100)), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 3, Fraction(85, 100))
    assert written and max(written.values()) <= 60


def test_near_duplicates_odd_rows(spark):
    rows = [(7, BASE), (7, BASE), (None, BASE), (None, None), (3, BASE)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("7", "3", False), ("7", "3", False), ("None", "None", True), ("None", "None", True), ("3", "3", True)])


# ---- 10 byte pairs

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    codec = bpe.Codec.of(MULTI, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_documents(docs, empty, oracle):
    want = {i: (oracle[1].encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS}
    got = rows_of(bpe.encode_documents(docs, path=MULTI, pattern=public_tokenizers.PATTERN, decoded="back"), "ids", "back")
    assert {i: (a, bytes(b)) for i, (a, b) in got.items()} == want
    digests = rows_of(bpe.encoding_digests(docs, path=MULTI, pattern=public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    assert digests == {i: (len(a), hashlib.sha256(",".join(map(str, a)).encode()).hexdigest(), hashlib.sha256(b).hexdigest()) for i, (a, b) in want.items()}
    assert bpe.encode_documents(empty, path=MULTI, pattern=public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab th eingor\n\té’'s日本1!?\0", max_size=120))
def test_bpe_any_text(oracle, text):
    codec, enc = oracle
    ids = codec.encode(text)
    assert ids == enc.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "e", "ation", "xq", "é", "00"]), max_size=60).map("".join))
def test_bpe_tree_is_a_monoid(oracle, text):
    codec, _ = oracle
    data = text.encode()
    if data:
        whole = codec.merged(data)
        assert codec.tree(data) == whole
        for cut in range(0, len(data) + 1, 5):
            assert codec.join(codec.merged(data[:cut]) if cut else (), codec.merged(data[cut:]) if cut < len(data) else ()) == whole
