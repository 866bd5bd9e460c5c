"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, html_extract, jpeg, lm, media, nn, packing, quality, sharding, simhash, suffixes, toxicity
from lodestone.llm.tokens import byte_ranks, unit_encoder, unit_starts, units_of

SCHEMA = "doc_id long, text string, size long, score double, source string"
LONG = " ".join(f"word{i % 997} x{i % 31}" for i in range(4000))
CLEAN = "the quick brown fox jumps over the lazy dog while nine small birds sing in the old oak tree near the river bank today"
ODD = [None, "", " ", "a", "a", CLEAN, CLEAN, CLEAN + " again", LONG, "\n\n \t", "é" * 300, "日本語 テキスト", "x" * 5000, "a\x1cb", "don't we'll  I'M 12 !!??", "\n" * 70 + "z"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, 7, 0.5, "s") for i, t in enumerate(ODD)] + [(5, CLEAN, 7, 0.5, "s")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# --- media


def test_payload_round_trip_and_progressive_scans():
    rng = np.random.default_rng(3)
    payloads = [b"\0" * 64, bytes(range(256)) * 9, rng.integers(0, 256, 64 * 777, dtype=np.uint8).tobytes(), b"\xff" * 640]
    files = [jpeg.encode_payload(p) for p in payloads]
    images, coefficients = jpeg.decode_coefficients(files)
    assert [jpeg.read_payload(i, coefficients) for i in images] == payloads
    scans = [(s.ss, s.se, s.ah, s.al) for s in images[0].scans]
    assert (0, 0, 0, 1) in scans and (0, 0, 1, 0) in scans and (6, 63, 0, 1) in scans and (1, 63, 1, 0) in scans
    for image, payload in zip(images, payloads):
        t = jpeg.rgb(image, coefficients)
        assert t.shape == (image.height, image.width, 3) and t.size >= len(payload) // 2
    alone, own = jpeg.decode_coefficients(files[1:2])
    assert jpeg.describe(jpeg.rgb(alone[0], own)) == jpeg.describe(jpeg.rgb(images[1], coefficients))


def test_refinement_symbol_by_symbol():
    """New coefficients and corrections mixed, written bit by bit, read back by the general path."""
    codes = {0x01: "00", 0x00: "01", 0x11: "10", 0xF0: "110"}
    by_length = {2: [0x01, 0x00, 0x11], 3: [0xF0]}
    lut = jpeg.lookup(bytes(len(by_length.get(n, ())) for n in range(1, 17)) + bytes([1, 0, 0x11, 0xF0]))
    block = np.zeros((1, 64), dtype=np.int32)
    block[0, 1], block[0, 4] = 2, -2
    # a new +1 at 2 (run 0 from 1: the correction of 1 comes on the way), a new -1 after one zero (3 skipped, 4 corrected): at 5; end
    bits = codes[0x01] + "1" + "1" + codes[0x11] + "0" + "0" + codes[0x00]
    data = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    jpeg.refine_one(data, np.array([0]), lut, 1, 63, 0, block)
    assert block[0, :7].tolist() == [0, 3, 1, 0, -2, -1, 0]


def test_inverse_transform_is_the_cosine_transform():
    rng = np.random.default_rng(5)
    c = rng.integers(-200, 200, (5, 64))
    natural = np.zeros((5, 64))
    natural[:, jpeg.zigzag()] = c
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(0.5), 1) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    exact = np.clip(np.einsum("nuv,ux,vy->nxy", natural.reshape(5, 8, 8), one, one) + 128, 0, 255)
    assert np.abs(jpeg.samples(c, np.ones(64)) - exact).max() <= 1


def test_media(spark, odd, empty):
    rows = media.digest_media(media.store_texts(odd)).collect()
    assert len(rows) == len(ODD) + 1
    by_text = collections.defaultdict(set)
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        by_text[raw].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    tensors = media.decode_media(media.store_texts(odd)).collect()
    assert all(len(t["tensor"]) == 3 * t["height"] * t["width"] for t in tensors) and len(tensors) == len(rows)
    assert media.digest_media(media.store_texts(empty)).count() == 0


# --- tokens, packing, BPE


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_units_encode_like_the_whole(text):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary(text)
    assert "".join(units_of(text)) == text
    assert np.frombuffer(unit_encoder(path, P.PATTERN)(text), "<u4").tolist() == whole
    own = bpe.codec(path, P.PATTERN)
    assert list(own.encode_batch([text])) == [whole] and own.decode(whole) == text.encode()


def test_long_pieces():
    import time

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    rng = np.random.default_rng(3)
    own = bpe.codec(path, P.PATTERN)
    for n in (511, 512, 513, 3000, 100_000):
        text = "".join(rng.choice(list("abcdeéinostr"), n))
        start = time.perf_counter()
        assert list(own.encode_batch([text])) == [e.encode_ordinary(text)]
        assert time.perf_counter() - start < 3


def test_bpe(odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    for r in bpe.round_trip_digest(odd, path, P.PATTERN).collect():
        text = ODD[r["doc_id"]] or ""
        ids = e.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip_digest(empty, path, P.PATTERN).count() == 0
    encoded = bpe.encode_documents(odd, path, P.PATTERN)
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in bpe.decode_documents(encoded, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(ODD)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_pack_fills(lengths):
    lengths = sorted(lengths, reverse=True)
    out = packing.pack(lengths, 40)
    used = collections.Counter()
    got = collections.Counter()
    for item, _, n, s, offset in out:
        assert offset == used[s]
        used[s] += n
        got[item] += n
    assert all(n <= 40 for n in used.values()) and got == collections.Counter(dict(enumerate(lengths)))
    assert len(used) <= -(-sum(lengths) // 40)


def test_packing(odd, empty, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd, path, P.PATTERN).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in enumerate(ODD):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by[i], key=lambda r: r["start"])
        copies = 2 if i == 5 else 1
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    packed = packing.pack_documents(docs, path, P.PATTERN).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in packed.groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 1024
    assert packed["length"].sum() > 0.99 * 1024 * packed["sequence_id"].nunique()
    assert packing.pack_documents(empty, path, P.PATTERN).count() == 0


# --- sharding


def test_sharding(spark, odd, empty):
    hot = spark.createDataFrame([(i, "copy of one text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(3000)], "doc_id long, text string")
    p = sharding.shard_documents(hot).toPandas()
    assert len(p) == 3000 and set(p["shard"]) == set(range(8))
    for _, s in p.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    for c in ("size", "tokens"):
        load = p.groupby("shard")[c].sum()
        assert load.max() <= 1.03 * load.mean()
    assert p.groupby("shard").size().max() <= 1.1 * 3000 / 8
    # a group that fits a shard stays in one, the one that doesn't is dealt out; nothing else is split with it
    some = spark.createDataFrame([(i, f"group {i % 40}" if i % 2 else "hot") for i in range(1000)], "doc_id long, text string")
    per_group = sharding.shard_documents(some).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["n"] == 1 for r in per_group if r["rows"] <= 125) and max(r["n"] for r in per_group) == 8
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sharding.shard_documents(real).groupBy("size", "text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r["size"] == len((ODD[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((ODD[r["doc_id"]] or "").encode()) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


# --- near duplicates


def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            least = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            changed |= least < label[i]
            label[i] = least
    return label


def test_simhash(odd, empty):
    rows = simhash.near_groups(odd).collect()
    fps = {i: brute_fingerprint(t, 3) for i, t in enumerate(ODD)}
    label = brute_components(fps)
    assert len(rows) == len(ODD) + 1
    assert all(r["fp"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == label[r["doc_id"]] for r in rows)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("limit", [5, 20_000])
def test_links_are_complete_whatever_the_limit(spark, limit):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(15)]
    fps = list(dict.fromkeys(fps))
    reps = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = {(min(a, b), max(a, b)) for a, b in simhash.block_links(reps, 3, limit).collect()}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        parent[max(root(a), root(b))] = min(root(a), root(b))
    label = brute_components(dict(enumerate(fps)))
    assert [root(i) for i in range(len(fps))] == [label[i] for i in range(len(fps))]


def test_one_of_each(odd):
    rows = simhash.one_of_each(odd).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and 3 in ids and 4 not in ids and set(rows[0].asDict()) == set(odd.columns)


# --- repeats


def test_repeats_against_brute_force(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1 << 15)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 1 << 10)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = sorted(suffixes.brute_force(rows))
    assert sorted(tuple(r) for r in suffixes.digest(docs).collect()) == want
    plain = [(i, (t or "").encode()) for i, t in enumerate(ODD)] + [(5, CLEAN.encode())]
    assert sorted(tuple(r) for r in suffixes.digest(odd).collect()) == sorted(suffixes.brute_force(plain))
    assert suffixes.digest(empty).count() == 0
    kept = suffixes.cut_repeats(odd).collect()
    assert all((r["row"]["size"], r["row"]["score"], r["row"]["source"]) == (7, 0.5, "s") for r in kept)


def test_repeats_keep_what_is_not_cut(spark):
    """Genuine replacement characters, null texts, rows without an id and columns of any kind and name stay as they are."""
    import datetime

    passage = "a passage of many bytes that two documents share, longer than fifty of them"
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(1, passage, at, 7, b"\x00\xff"), (2, f"keep \ufffd this. {passage} \ufffd end", at, 7, None), (3, None, at, None, b""), (None, f"{passage}!", at, 7, None), (None, f"{passage}?", None, 7, None), (4, "é" * 40, at, 7, None), (5, "xé" + "é" * 39, at, 7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, content timestamp, n_removed int, row binary")
    got = suffixes.cleaned_documents(d)
    assert got.columns == d.columns and got.schema == d.schema
    out = {(r["doc_id"], r["content"], r["text"]): r for r in got.collect()}
    want = [(1, at, passage), (2, at, "keep \ufffd this.  \ufffd end"), (3, at, None), (None, at, "!"), (None, None, "?"), (4, at, "é" * 40), (5, at, "x")]
    texts = {(r[0], r[1]): r[2] for r in out}
    assert texts[2, at].startswith("keep \ufffd this.") and texts[2, at].endswith("\ufffd end") and passage not in texts[2, at]
    assert {k for k in out if k[0] != 2} == {w for w in want if w[0] != 2}
    assert out[1, at, passage]["row"] == b"\x00\xff" and out[3, at, None]["n_removed"] is None


def test_long_repeats_go_through_the_tree():
    """Copies of a whole string are a repeat of the tree like any other."""
    strings = [b"x" * 5 + b"abcdefgh" * 8, b"abcdefgh" * 8 + b"y" * 3]
    got = sorted(suffixes.smallest_documents(strings, [3, 1], [9, 1], 50))
    assert (0, 0, len(strings[0]), 3) in got and any(x[0] == 0 and x[3] == 1 for x in got) and all(x[0] == 0 for x in got)


def test_a_flush_does_not_depend_on_the_number_of_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1 << 11)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 16)
    few = docs.filter("doc_id < 60")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in few.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in suffixes.digest(few).collect()) == sorted(suffixes.brute_force(rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=24), max_size=8))
def test_maximal_repeats(parts):
    strings = [p.encode() for p in parts]
    for n, found in suffixes.maximal_repeats(strings, 3):
        texts = {strings[s][i : i + n] for s, i in found}
        assert len(texts) == 1
        every = [(s, i) for s, x in enumerate(strings) for i in range(len(x) - n + 1) if x[i : i + n] in texts]
        assert sorted(found) == every
    covered = {strings[s][i : i + 3] for n, f in suffixes.maximal_repeats(strings, 3) for s, at in f for i in range(at, at + n - 2)}
    grams = collections.Counter(x[i : i + 3] for x in strings for i in range(len(x) - 2))
    assert covered == {g for g, c in grams.items() if c > 1}


def test_keys_that_the_same_sets_share_come_as_one(spark, monkeypatch):
    """Two long documents with one passage in common share one key, not one for each shingle of the passage; so do many."""
    rng, made = random.Random(2), []
    passage = [f"common{i}" for i in range(120)]
    rows = [(i, " ".join([*passage, *[f"w{i}x{rng.randrange(10**6)}" for _ in range(30)]])) for i in range(6)]
    rows += [(100 + i, " ".join([*[f"other{i // 2}x{k}" for k in range(120)], *[f"y{i}x{k}" for k in range(30)]])) for i in range(20)]
    keys = simhash.prefix_keys
    monkeypatch.setattr(simhash, "COMMON", 0)
    monkeypatch.setattr(simhash, "prefix_keys", lambda *a: made.append(keys(*a).collect()) or spark.createDataFrame(made[-1], "key long, same long"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    times = collections.Counter(r["same"] for r in made[0])
    assert len(made[0]) == len(set(made[0])) and len(times) == 26 and max(times.values()) <= 12
    assert sum(times.values()) < 26 * 4


def test_groups_of_one_name_lose_no_pair(spark, monkeypatch):
    """Whatever groups get one name: the same classes."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(40)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    monkeypatch.setattr(simhash, "short", lambda hashes: (hashes >> np.uint64(60)).view(np.int64))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_a_sieve_holds_back_no_key(spark, monkeypatch):
    """Every key passes, few other rows do; more keys than the map has bits for let more pass."""
    d = spark.range(-4000, 4000).select("id", F.xxhash64("id").alias("h"), F.lit("t").alias("text"))
    for bits, most in (((16, 1 << 25), 0.12), ((16, 64), 1.0)):
        monkeypatch.setattr(common, "SIEVE", bits)
        for keys in (d.filter("id % 20 = 0"), d.limit(0)):
            rows = common.sieved(d, "h", keys.select(F.col("h").alias("k")), "k")
            assert rows.columns == ["id", "h", "text", "sieved"] and rows.count() == 8000
            passed = {r["id"] for r in rows.filter("sieved").collect()}
            want = {r["id"] for r in keys.collect()}
            assert want <= passed and len(passed) <= 8000 * (most if want else 0)


def test_rows_that_stay_are_not_shuffled(spark):
    """Of documents of which few go, the texts of those that stay meet no join, however many go."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "a copy of one text").otherwise(F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(k)), 256) for k in range(8)])).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.one_of_each(d)
        assert sorted(r[0] for r in out.select("doc_id").collect()) == [0, *range(40, 3000)]
        branches = out._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")
        assert len(branches) == 2 and "Union" in branches[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_outside_the_innermost_block(spark):
    """Such a table is there after its block, and goes with the block around it."""
    with common.temporary(spark):
        with common.temporary(spark):
            inner, outer = common.stored(spark.range(3)), common.stored(spark.range(5), outer=True)
            kept = common.stored(spark.range(7), keep=True)
        assert outer.count() == 5
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            inner.collect()
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        outer.collect()
    assert kept.count() == 7


# --- language model


def test_lm(spark, docs, empty, odd):
    rows = docs.select("doc_id", "text").collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update((r["text"] or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for r in rows:
        words = [*(r["text"] or "").encode().lower().split(), b""]
        q = got[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(base - q["base_score"]) < 1e-6 and q["n_known"] == sum(counts[w] > 0 for w in words)
        assert (q["n_tokens"], q["train_tokens"], q["held_out"]) == (len(words), n, not zlib.crc32(str(r["doc_id"]).encode()) % 10)
    held = [q for q in got.values() if q["held_out"]]
    assert sum(q["score"] for q in held) > sum(q["base_score"] for q in held)
    assert lm.score_documents(empty).count() == 0
    assert lm.score_documents(odd).count() == len(ODD) + 1


def test_lm_score_is_the_sum_of_its_parts(spark, docs, monkeypatch):
    """Known words by the network, all others by their class and their share in it."""
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    corpus, counts = kept[0], collections.Counter()
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update([*(r["text"] or "").encode().lower().split(), b""])
    for r in rows[:60]:
        words = [*(r["text"] or "").encode().lower().split(), b""]
        own = corpus.model.scores([np.array([corpus.model.number(w) for w in words])])[0]
        for w in words:
            if w not in corpus.model.known:
                k = lm.tail_of(w)
                own += math.log10((counts[w] + 0.1) / (corpus.tail_tokens[k] + 0.1 * (corpus.tail_types[k] + 1)))
        assert abs(own - got[r["doc_id"]]) < 1e-3 * max(1, len(words) / 100)


def test_every_training_document_is_learned_from(spark):
    """Weights come from all tasks' documents, by tokens: a word pair that only late documents have is learned too."""
    rows = [(i, " ".join((["left", "right"] if i >= 1500 else ["up", "down"]) * 12)) for i in range(3000)]
    scores = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r["score"] > r["base_score"] for r in scores)


def test_lm_carries_its_state_and_sums_to_one():
    rng = np.random.default_rng(0)
    model = lm.init([(b"", 5), *[(f"w{i}".encode(), 50 - i) for i in range(49)]], np.ones(lm.TAILS) * 3)
    texts = [rng.integers(0, 50, n) for n in (1, 31, 32, 33, 100, 257)]
    together = model.scores(texts)
    for t, s in zip(texts, together):
        assert abs(model.scores([t])[0] - s) < 1e-3
    h = np.zeros((1, lm.HIDDEN), dtype=np.float32)
    every = np.arange(50 + lm.TAILS)
    assert abs(np.exp(model.log_likelihood(np.repeat(h, len(every), axis=0), every)).sum() - 1) < 1e-4


def test_lm_learns_from_classes_in_small_runs(monkeypatch):
    """The gradients of a window are the same for any run of rows, against plain ones; no run is longer than NEAR."""
    rng = np.random.default_rng(6)
    model = lm.init([(b"", 5), *[(f"w{i}".encode(), 50 - i) for i in range(49)]], np.ones(lm.TAILS) * 3)
    x, y = rng.integers(0, 50 + lm.TAILS, (2, 32, 90))
    y[20:, 70:] = -1
    sizes, found, plain = [], [], lm.softmax
    monkeypatch.setattr(lm, "softmax", lambda d, *a: sizes.append(d.shape) or plain(d, *a))
    for near in (64, lm.NEAR, 1 << 20):
        monkeypatch.setattr(lm, "NEAR", near)
        sizes.clear()
        found.append(lm.gradients(model, x, y, np.zeros((90, lm.HIDDEN), dtype=np.float32))[0])
        assert max(n for n, k in sizes if k > lm.TAILS) == min(near, int((y >= 0).sum()))
    for k, v in found[0].items():
        assert all(np.allclose(v, other[k], rtol=1e-3, atol=1e-6) for other in found[1:]), k
    used, inverse = np.unique(x, return_inverse=True)
    assert not found[0]["embed"][np.setdiff1d(np.arange(len(model.params["embed"])), used)].any()
    p = model.params
    states, _ = nn.gru_forward((p["embed"][used] @ p["gru.W"] + p["gru.b"])[inverse.reshape(x.shape)], np.zeros((90, lm.HIDDEN), dtype=np.float32), p["gru.U"], (y >= 0).astype(np.float32))
    on = y >= 0
    z = states[on].astype(np.float64) @ p["class.W"] + p["class.b"]
    d = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    d[np.arange(len(d)), model.class_of(y[on])] -= 1
    assert np.allclose(d.mean(axis=0), found[0]["class.b"], atol=1e-6) and np.allclose(states[on].T @ d / len(d), found[0]["class.W"], atol=1e-6)


def test_lm_looks_at_logits_only_if_weights_are_large():
    """A bound on all logits spares the look at each of them; large ones are still shifted."""
    rng = np.random.default_rng(7)
    states = lm.with_one(rng.uniform(-1, 1, (200, lm.HIDDEN)).astype(np.float32))
    for size in (1, 40):
        weights = rng.standard_normal((90, lm.HIDDEN + 1)).astype(np.float32) * size
        small = lm.within(states, weights)
        logits = states @ weights.T
        assert small == (size == 1) and (not small or np.abs(logits).max() < 60)
        want = np.exp(logits.astype(np.float64) - logits.max(axis=1, keepdims=True))
        assert np.allclose(lm.softmax(logits.copy(), small), want / want.sum(axis=1, keepdims=True), rtol=1e-3, atol=1e-6)
    assert lm.within(states[:0], states[:0])


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = nn.init_gru(rng, 3, 4, "g")
    x = rng.standard_normal((6, 2, 3)).astype(np.float32)
    mask = np.ones((6, 2), dtype=np.float32)
    mask[4:, 1] = 0

    def loss(u):
        return float((nn.gru_forward(x @ p["g.W"] + p["g.b"], np.zeros((2, 4), dtype=np.float32), u, mask)[0] ** 2).sum())

    out, kept = nn.gru_forward(x @ p["g.W"] + p["g.b"], np.zeros((2, 4), dtype=np.float32), p["g.U"], mask)
    _, d_u = nn.gru_backward(2 * out, kept, p["g.U"])
    for i, j in ((0, 0), (3, 5), (2, 11)):
        up, down = p["g.U"].copy(), p["g.U"].copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - d_u[i, j]) < 2e-2 * max(1, abs(d_u[i, j]))


# --- toxicity


def test_toxicity_on_held_out_texts(spark, odd, empty):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "paper", "light"]
    bad = ["nastyword", "vileterm", "rudething"]

    def text(toxic):
        w = rng.choice(words, 90).tolist()
        if toxic:
            for _ in range(3):
                w[rng.integers(90)] = bad[rng.integers(3)]
        return " ".join(w)

    labels = [i % 4 == 0 for i in range(400)]
    rows = [(i, text(y)) for i, y in enumerate(labels)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(t)) for i, t in enumerate(labels)], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, model).collect()}
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 5]
    assert np.mean([(scores[i] >= 0.5) == labels[i] for i in held]) > 0.95
    assert toxicity.score_documents(odd, model).count() == len(ODD) + 1 and toxicity.score_documents(empty, model).count() == 0
    clash = odd.withColumns({"_score": F.lit(1), "kept_0": F.lit("k"), "label": F.lit(3), "row": F.current_timestamp()})
    kept = toxicity.kept_documents(clash, model)
    assert kept.columns == clash.columns and kept.schema == clash.schema
    own = {r["doc_id"]: r["score"] for r in toxicity.score_documents(odd, model).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in own.items() if x < 0.5} and toxicity.kept_documents(empty, model).count() == 0
    assert toxicity.fit(d.limit(0), y.limit(0)).scores([b"x", b""]) == [0.0, 0.0]


def test_every_window_counts():
    """A text's score is the largest of its windows', each scored as a text of its own."""
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in range(40)]
    texts = [" ".join(rng.choice(words, 60).tolist() + (["vile"] if i % 2 else [])).encode() for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)])
    for n in (1, 32, 33, 100, 257):
        own = rng.choice([*words, "vile"], n).tolist()
        alone = [model.scores([" ".join(own[s : s + toxicity.LENGTH]).encode()])[0] for s in toxicity.windows_of(n)]
        assert abs(model.scores([" ".join(own).encode()])[0] - max(alone)) < 1e-4


def test_toxicity_reads_characters_of_unseen_words():
    """Every bad word is another one, so that no list of words can know it: only its characters can."""
    rng = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "paper", "light"]
    made = lambda: "zqx" + "".join(rng.choice(list("aeiou"), 4)) + "xqz"

    def text(bad):
        w = rng.choice(words, 50).tolist()
        if bad:
            w[int(rng.integers(50))] = made()
        return " ".join(w).encode()

    labels = [int(i % 2) for i in range(400)]
    texts = [text(y) for y in labels]
    model = toxicity.train(texts[:300], labels[:300])
    scores = model.scores(texts[300:])
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(scores, labels[300:])]) > 0.9


def test_windows_cover():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        starts = toxicity.windows_of(n)
        assert {i for s in starts for i in range(s, s + toxicity.LENGTH)} >= set(range(n))


# --- quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, empty, docs):
    extra = ["a b c d e a b c d e", "a a a a a a", "l\nl\n\nl\nm", "x y z w v u " * 30]
    df = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for d, texts in ((odd, dict(enumerate(ODD))), (df, dict(enumerate(extra))), (docs, {r["doc_id"]: r["text"] for r in docs.collect()})):
        for r in quality.statistics(d).collect():
            assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(texts[r["doc_id"]])
    assert quality.statistics(empty).count() == 0


def test_labels_in_the_documents_don_t_clash(spark):
    d = spark.createDataFrame([(i, "some words " * (i % 9 + 6), "x", 1) for i in range(40)], "doc_id long, text string, label string, label_id int")
    y = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert isinstance(quality.fit(d, y), list)


def test_decision_list(spark, odd, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        if i % 5 == 0:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 != 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.fit(d, y)
    kept = {r["doc_id"] for r in quality.judge(d, rules).filter("kept").collect()}
    assert rules and kept == {i for i, q in labels if q}
    assert {r["doc_id"] for r in quality.kept_documents(d, rules).collect()} == kept
    assert quality.fit(d, y.limit(0)) == [] and quality.fit(d, y.filter("quality = 1")) == []
    out = quality.kept_documents(odd, rules)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} <= set(range(len(ODD))) and quality.kept_documents(empty, rules).count() == 0
    plan = quality.judge(d, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="post-{n} entry"><h1>Title {n} &amp; more</h1><p>First <b>para</b>graph of page {n}, long enough to count.<p>Second&nbsp;one &lt;here&gt;<br>and on
<ul><li>item one<li>item two</ul><div class="ad">Buy</div><form><p>Name</p></form><!-- no --><pre>code   here</pre></div><aside class="sidebar"><p>Other posts and other things to read</p></aside>
<div class="comments"><p>Nice post {n}, I like it so very much and so on, much longer than the article itself, again and again and again and again, {filler}</p></div><footer>&copy; me</footer>"""
TEXT = "Title {n} & more First paragraph of page {n}, long enough to count. Second one <here> and on item one item two code here"


def test_html(spark, empty):
    rows = [(i, "http://h.org/x" if i < 8 else f"http://k{i}.org/", PAGE.format(n=i, filler="long " * 50)) for i in range(10)]
    rows += [(20, None, None), (21, "http://z.org", ""), (22, "not a url", "just <b>text"), (23, "http://z.org", "<p>unfinished <"), (24, "http://h.org/", "<div><p>" * 300 + "deep"), (0, "http://h.org/x", PAGE.format(n=0, filler=""))]
    d = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    got = collections.defaultdict(list)
    for r in html_extract.extract_pages(d).collect():
        got[r["page_id"]].append(r["text"])
    for i in range(10):
        assert set(got[i]) == {TEXT.format(n=i)}
    assert got[20] == [""] and got[21] == [""] and got[22] == ["just text"] and got[24] == ["deep"] and len(got[0]) == 2
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(none).count() == 0


def test_consensus_beats_a_page(spark):
    """One page whose longest container is something else is extracted by its host's path."""
    usual = "<body><div class=main><p>{t}</p></div><div class=extra{n}><p>short</p></div></body>"
    rows = [(i, "http://h/", usual.format(t="article text number " * 10, n=i)) for i in range(6)]
    rows.append((9, "http://h/", "<body><div class=main><p>brief</p></div><div class=extra9><p>" + "long promo words " * 40 + "</p></div></body>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(d).collect()}[9] == "brief"


def test_inside_an_article_names_of_page_parts_are_text():
    page = '<body><article><div class="post-header"><h1>Head</h1></div><p>words of the article</p><p class="legal">legal words</p><div class="ad">buy</div><div class="comments"><p>nice</p></div></article><div class="legal">no</div></body>'
    assert html_extract.extract(page, None)[0] == "Head words of the article legal words"


@pytest.mark.parametrize("tag", ["div", "b", "p"])
def test_deep_nesting_is_quick(tag):
    import time

    page = "<html><body>" + f"<{tag}>x" * 10_000
    start = time.perf_counter()
    best = html_extract.votes(page)
    html_extract.extract(page, best[0][0])
    assert time.perf_counter() - start < 3


# --- all together


def brute_cut(rows, length=50):
    """Texts without what an earlier document has: every byte looked at, characters cut in two left out."""
    first, out = {}, {}
    for d, t in rows:
        c = t.encode()
        for i in range(len(c) - length + 1):
            first[c[i : i + length]] = min(first.get(c[i : i + length], d), d)
    for d, t in rows:
        c = t.encode()
        gone = bytearray(len(c))
        for i in range(len(c) - length + 1):
            if first[c[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        parts, part = [], bytearray()
        for x, g in zip(c, gone):
            if g:
                parts.append(bytes(part))
                part.clear()
            else:
                part.append(x)
        out[d] = "".join(p.decode("utf-8", "ignore") for p in [*parts, bytes(part)]) if any(gone) else t
    return out


def test_pipeline(spark):
    """Every stage against brute force on all its input."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = d.columns
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
        source = d
        d = common.stored(stage(spark, d, sf))
        if name == "packing":
            break
        assert d.columns == names
        after = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
        assert after
        if name == "quality":
            rules = quality.fit(source, labels)
            x = {r["doc_id"]: np.array([[r[f] for f in quality.FEATURES]], dtype=np.float64) for r in quality.statistics(source).collect()}
            words = {i: brute_statistics(t) for i, t in before.items()}
            assert set(after) == {i for i, w in words.items() if w[0] >= 10 and 100 * w[4] <= 20 * w[0] and not any(quality.covers(rule, x[i])[0] for rule in rules)}
        elif name == "toxicity":
            model = toxicity.fit(source, labels)
            assert set(after) == {i for i, t in before.items() if model.scores([t.encode()])[0] < C.TOXIC}
        elif name == "near_dedup":
            groups = brute_groups(sorted(before.items()))
            assert set(after) == {i for i, g in groups.items() if i == g}
        else:
            assert after == brute_cut(sorted(before.items()))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
    assert len(d.columns) == 7 and sum(r["length"] for r in d.collect()) == want


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Nulls, ties, repeats, clashing and extra columns: rows of the same columns come out, of an empty table none."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    clash = odd.withColumns({c: F.lit(1) for c in ("label", "first_id", "_score", "_id", "mark", "content", "block", "n_removed", "part")})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert all(r["size"] == 7 and r["label"] == 1 for r in rows) and len(rows) <= len(ODD) + 1
        if name == "repeat_dedup":
            assert len(rows) == len(ODD) + 1 and sum(r["text"] is None for r in rows) == 1
        assert stage(spark, empty, sf).count() == 0, name
    assert C.STAGES[-1][1](spark, empty, sf).count() == 0


def test_similar_documents_are_one_group(spark):
    """Copies with one word in sixty changed (similarity above 0.8) go, halves and strangers stay, copies are cheap."""
    rng = np.random.default_rng(8)
    rows, near = [], {}
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 500)))]
        rows.append((i, " ".join(words)))
        for k in range(i % 3):
            edited = list(words)
            for at in rng.choice(len(words), len(words) // 70 + (len(words) < 70), replace=False):
                edited[at] = "changed"
            near[1000 + 10 * i + k] = i
            rows.append((1000 + 10 * i + k, " ".join(edited)))
        rows.append((5000 + i, " ".join(words[: len(words) // 2] + [f"z{x}" for x in rng.integers(0, 4000, len(words) // 2)])))
    rows += [(9000 + i, "one very common text of many words that thousands of documents hold as it is") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(d).collect()}
    text = dict(rows)
    close = {c: o for c, o in near.items() if len(shingles_of(text[c]) & shingles_of(text[o])) >= 0.8 * len(shingles_of(text[c]) | shingles_of(text[o]))}
    assert len(close) > 40 and all(got[c] == got[o] for c, o in close.items())
    assert all(got[5000 + i] == 5000 + i and got[i] == i for i in range(60))
    assert {got[9000 + i] for i in range(300)} == {9000}


def shingles_of(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_groups(rows, least=0.8):
    """Smallest id of the group of every id, by all pairs."""
    ids, sets = [i for i, _ in rows], [shingles_of(t) for _, t in rows]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = sorted((root(ids[i]), root(ids[j])))
                up[y] = x
    return {i: root(i) for i in ids}


def test_one_of_each_keeps_rows_without_ids_and_unlike_rows_of_one_id(spark, empty):
    rows = [(None, "first text of no id"), (None, "second text of no id, unlike the first"), (7, "a text of seven"), (7, "another text of seven, quite unlike"), (7, "a text of seven"), (3, "a text of seven"), (None, "a text of seven"), (9, None), (8, "")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, first_id int, place int")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(d).collect())
    assert got == sorted([("None", rows[0][1]), ("None", rows[1][1]), ("7", rows[3][1]), ("3", "a text of seven"), ("8", "")])
    again = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.one_of_each(again).collect()] == [(1, "same")]
    assert simhash.one_of_each(empty).count() == 0 and simhash.similar_groups(empty).count() == 0


def test_hot_keys_are_refined(spark, monkeypatch):
    """Many unlike documents under one key, and near copies among them: the same groups with any limit."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(0, 900, 22)]
        rows.append((2 * i, " ".join(["one two three four five six"] * (i % 2) + words)))
        rows.append((2 * i + 1, " ".join(["one two three four five six"] * (i % 2) + [*words[:-1], "end"])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    monkeypatch.setattr(simhash, "COMMON", 0)
    keys = simhash.prefix_keys
    for limit in (3, 20_000):
        monkeypatch.setattr(simhash, "prefix_keys", lambda nodes, least: keys(nodes, least, limit))  # noqa: B023
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(d).collect()} == want


def test_no_similar_pair_is_missed(spark):
    """Short texts edited at their ends, which share no whole segment, and a hot group of near copies: as by all pairs."""
    rng = np.random.default_rng(21)
    rows = []
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    for i in range(150):
        words = draw(int(rng.integers(14, 60)))
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join([*words[:-1], "other"])))
        rows.append((10 * i + 2, " ".join(["another", *words[1:-1], "end"])))
    hot = draw(90)
    for i in range(80):
        words = list(hot)
        for at in rng.choice(90, int(rng.integers(1, 4)), replace=False):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((5000 + i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_long_documents_are_held_against_their_whole_sets(spark):
    """Above 1024 shingles, pairs just above and just below 0.8, where estimates err on either side."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 2400)]
        edited = list(words)
        n, k = len(words) - 4, 0
        target = 0.803 if i % 2 else 0.797
        while (n - 5 * k) / (n + 5 * k) > target:
            edited[8 + 9 * k] = f"y{i}_{k}"
            k += 1
        k -= i % 2
        if i % 2:
            edited[8 + 9 * k] = words[8 + 9 * k]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert got == want and sorted(want[2 * i + 1] == 2 * i for i in range(40)) == [False] * 20 + [True] * 20


def test_a_pair_of_near_copies_is_a_candidate_once(spark, monkeypatch):
    """Sets that share many keys are held against each other under one of them, whichever task has the others."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(11)
    rows, made = [], []
    for group in range(12):
        words = [f"w{group}x{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(8):
            own = list(words)
            own[rng.randrange(400)] = f"new{group}x{k}"
            rows.append((len(rows), " ".join(own)))
    pairs = simhash.allowed_pairs

    def counted(candidates, least, every):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "distinct", lambda self: self)
            out = pairs(candidates, least, every).collect()
        made.append((len(out), len(set(out))))
        return spark.createDataFrame(out, "a long, b long")

    monkeypatch.setattr(simhash, "allowed_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 8 for i in range(len(rows))}
    assert made[0] == (12 * 28, 12 * 28) and made[1][0] == made[1][1]


def test_forms_of_units_join_to_those_of_whole_texts():
    """What is kept for a unit (decimals, bytes) gives a text's, with a cache that is emptied in between too."""
    texts = ["", " ", "  ", " a", "a ", "one two  three\n four", "it's ÄÖ 12345 -- x\t y", "one two", "\n", "qzxv" * 5 + " wxyzq jkjkq"]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = bpe.ByteBPE(path, P.PATTERN)
    for limit in (0, 1000):
        own = bpe.ByteBPE(path, P.PATTERN, limit)
        for _ in range(2):
            want = [(len(x), ",".join(map(str, x)), t.encode()) for t, x in zip(texts, plain.encode_batch(texts))]
            made = []
            own.decode = lambda ids: made.append(ids) or plain.decode(ids)  # noqa: B023
            assert list(own.round_trip(texts * 3)) == want * 3
            assert len(made) <= len({u for t in texts for u in units_of(t)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("  ab.é」語\n\t\x1c\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b«😀"), max_size=12), max_size=6))
def test_units_of_many_texts_at_once(texts):
    """Cutting all texts' bytes gives each text's units, and their ids are those of the library."""
    import tiktoken

    coded = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    ends = [*unit_starts(data, bounds).tolist(), len(data)]
    assert [bytes(data[a:b]).decode() for a, b in zip(ends, ends[1:])] == [u for t in texts if t for u in units_of(t)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    got = list(bpe.codec(path, P.PATTERN).round_trip(texts))
    assert got == [(len(x), ",".join(map(str, x)), t) for x, t in zip(map(e.encode_ordinary, texts), coded)]


def test_units_are_split_and_merged_together():
    """Few calls split a run's units, however many differ; a piece that is met again outlives those that are not."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.ByteBPE(path, P.PATTERN, 100)
    findall, merge, calls, merged = own.findall, getattr(own, "merge", None), [], []
    own.findall = lambda t: calls.append(t) or findall(t)
    own.merge = lambda pieces: merged.extend(pieces.to_pylist()) or merge(pieces)
    rng = np.random.default_rng(5)
    for _ in range(8):
        words = ["often" * 3, *("".join(rng.choice(list("qzxvké"), 14)) for _ in range(300)), "."]
        list(own.round_trip([" ".join(words), "second " + " ".join(words)]))
    assert len(calls) <= 8 * 5
    assert merged.count(" " + "often" * 3) == 1 and len(merged) >= 8 * 300
    assert len(own.young) + len(own.old) < 3 * 310


def test_pieces_of_all_widths():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdeéinostr语"), n)) for n in [*range(1, 40), 63, 64, 65, 128, 129, 200, 255, 256, 257, 300, 500, 512, 513] * 3]
    texts += ["a" * n for n in (31, 64, 255, 256, 511, 512)]
    assert list(bpe.ByteBPE(path, P.PATTERN).encode_batch(texts)) == [e.encode_ordinary(t) for t in texts]


def test_patterns_that_leave_something_out():
    own = bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), "[a-z]+")
    texts = ["some words 12 here", "", "34 5", " x"]
    assert [(n, c) for n, _, c in own.round_trip(texts)] == [(len(x), own.decode(x)) for x in own.encode_batch(texts)]
    assert [c for _, _, c in own.round_trip(texts)] == [b"somewordshere", b"", b"", b"x"]
    assert all(d == ",".join(map(str, x)) for (_, d, _), x in zip(own.round_trip(texts), own.encode_batch(texts)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", min_size=1, max_size=16), st.integers(0, 9), st.integers(0, 3)), max_size=10, unique_by=lambda x: x[0]))
def test_smallest_holders_of_strings_and_their_copies(parts):
    """What is reported covers just the strings that start in a smaller document too, second copies included."""
    strings, low, high = [p.encode() for p, _, _ in parts], [a for _, a, _ in parts], [a + b for _, a, b in parts]
    first: dict[bytes, int] = {}
    for s, a in zip(strings, low):
        for i in range(len(s) - 2):
            first[s[i : i + 3]] = min(first.get(s[i : i + 3], a), a)
    want = {(k, i, first[s[i : i + 3]]) for k, (s, b) in enumerate(zip(strings, high)) for i in range(len(s) - 2) if first[s[i : i + 3]] < b}
    got = {}
    for k, a, b, least in suffixes.smallest_holders(strings, low, high, 3).tolist():
        assert least < high[k]
        for i in range(a, b - 2):
            got[k, i] = min(got.get((k, i), least), least)
    assert {(*k, least) for k, least in got.items()} == want


def test_scores_hold_for_large_logits():
    """Sums of exponentials don't overflow, however large weights become, and biases enter once."""
    rng = np.random.default_rng(4)
    model = lm.init([(b"w%d" % i, 50 - i) for i in range(40)] + [(b"", 5)], np.ones(lm.TAILS))
    states, targets = rng.standard_normal((3000, lm.HIDDEN)).astype(np.float32), rng.integers(0, 41 + lm.TAILS, 3000)
    for size in (1, 300):
        model.params["class.W"] = rng.standard_normal(model.params["class.W"].shape).astype(np.float32) * size
        model.params["word.W"] = rng.standard_normal(model.params["word.W"].shape).astype(np.float32) * size
        p = {k: v.astype(np.float64) for k, v in model.params.items()}
        log_softmax = lambda x: x - x.max(axis=1, keepdims=True) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        own = model.class_of(targets)
        want = log_softmax(states @ p["class.W"] + p["class.b"])[np.arange(3000), own]
        for c, (a, b) in enumerate(zip(model.classes, model.classes[1:])):
            on = own == c
            want[on] += log_softmax(states[on] @ p["word.W"][a:b].T + p["word.b"][a:b])[np.arange(on.sum()), targets[on] - a]
        got = model.log_likelihood(states, targets)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-3)
