"""Each operator against its plain-Python version over a whole small table, and on odd and empty tables."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from recordloom.llm import exact_dedup, language_id, lm_scoring, lm_words, mixing, packing, quality, sharding, simhash, substring, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]


def picked(out, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in out}


def with_ids(df):
    return [r.asDict() for r in df.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


# 1


def test_exact(spark, rows):
    assert picked(run(spark, "op1_exact_dedup"), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def test_exact_splits_colliding_hashes(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = exact_dedup.exact_groups(docs, hash_of=lambda text: F.substring(F.md5(text), 1, 1))
    got = picked([r.asDict() for r in out.collect()], "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact(rows)


def test_exact_odd(odd, none):
    out = [r.asDict() for r in exact_dedup.exact_groups(odd).collect()]
    assert len(out) == odd.count()
    got = picked([r for r in out if r["doc_id"]], "doc_id", "keep_id", "group_size", "kept")
    assert got[1] == (1, 2, True) and got[2] == (1, 2, False) and got[10] == (10, 2, True)
    assert got[3] == (3, 3, True) and got[4] == (3, 3, False)
    assert {r["keep_id"] for r in out if r["doc_id"] is None} == {3, None}
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0


# 2


def check_mix(out, rows):
    size, target = brute.targets(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, largest = Counter(), Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == len(brute.words(next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])))
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert abs(sum(taken.values()) - sum(size.values())) <= max(largest.values())


def test_mix(spark, rows):
    out = run(spark, "op2_mixing")
    check_mix(out, rows)
    assert picked(out, "doc_id", "taken") == picked(run(spark, "op2_mixing"), "doc_id", "taken")


def test_mix_holds_small_sources_and_blocks_do_not_matter(make):
    docs = make(*[(i, "x " * (1 + i % 7), "en", f"s{i % 3}" if i < 30 else "hot") for i in range(400)])
    rows = [r.asDict() for r in docs.collect()]
    _, target = brute.targets(rows)
    one = [r.asDict() for r in mixing.mix(docs).collect()]
    check_mix(one, rows)
    many = [r.asDict() for r in mixing.mix(docs, block_rows=16).collect()]
    assert picked(one, "doc_id", "taken") == picked(many, "doc_id", "taken")


def test_mix_odd(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in out)
    whole = mixing.mixed(odd)
    assert whole.columns == odd.columns
    assert whole.count() == sum(r.passes for r in out)
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


# 3


def test_substring(spark, rows):
    assert picked(run(spark, "op3_substring_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("bucket_bytes", [1, 2_000, 6 << 20])
def test_substring_buckets_do_not_matter(make, bucket_bytes):
    base = [f"v{i}" for i in range(60)]
    docs = make(
        *[(i, " ".join([*(f"u{i}.{j}" for j in range(i % 9)), *base[i % 5 : 30 + i % 31], "z"] * (1 + i % 2)), "en", "s") for i in range(150)]
    )
    out = substring.remove_repeats(docs, bucket_bytes=bucket_bytes)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_text)) for r in out.collect()}
    want = brute.substring([r.asDict() for r in docs.collect()])
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}


def test_substring_odd(odd, none):
    out = [r.asDict() for r in substring.remove_repeats(odd).collect()]
    assert len(out) == odd.count()
    want = brute.substring(with_ids(odd))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out if r["doc_id"]} == {k: v[:2] for k, v in want.items()}
    assert want[8][1] == 40 and want[9][1] == 80
    assert substring.remove_repeats(none).count() == 0


# 4


def test_quality_counts(spark, rows):
    out = run(spark, "op4_quality_rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert picked(out, "doc_id", *names) == {r["doc_id"]: brute.quality_base(r["text"]) for r in rows}
    assert not any(r["base_failed"] and r["kept"] for r in out)


def test_binomial_tail_and_cutoffs():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    good, bad = np.zeros(256, int), np.zeros(256, int)
    good[:20], bad[100:] = 100, 5
    cut = quality.certified_cutoff(good, bad, 0.01, 0.01)
    assert 19 < cut <= 110
    assert quality.certified_cutoff(good // 50, bad, 0.01, 0.01) is None  # too few to certify anything


def test_quality_rejects_junk_and_spares_good(spark, make):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(40)), "en", "s") for i in range(0, 3000, 2)]
    junk = [(i, " ".join(f"w{(i * 7 + j * j) % 997}*** $$$" for j in range(40)), "en", "s") for i in range(1, 1200, 2)]
    docs = make(*good, *junk)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk[:300]], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(out[r[0]].kept for r in good) and not any(out[r[0]].kept for r in junk)
    assert {f for r in junk for f in out[r[0]].failed_rules} <= {"symbols", "marks"}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in good}


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(odd, labels).collect()
    assert len(out) == odd.count() and all(r.base_failed != r.kept for r in out)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}
    assert quality.quality(none, labels).count() == quality.keep_good(none, labels.limit(0)).count() == 0


# 5


def test_simhash(spark, rows):
    assert picked(run(spark, "op5_simhash"), "doc_id", "fingerprint", "component_id") == brute.simhash(rows)


def test_anchors_find_every_half_with_one_bit_changed():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300)
    for bit in range(32):
        y = x ^ (1 << bit)
        home = dict(zip(*simhash.anchors_within(x, 0), strict=True))
        index, anchor = simhash.anchors_within(y, 1)
        reached = defaultdict(set)
        for i, a in zip(index.tolist(), anchor.tolist(), strict=True):
            reached[i].add(a)
        assert all(home[i] in reached[i] for i in range(len(x)))


@pytest.mark.parametrize("homes", [2, 1 << 14])
def test_links_connect_what_close_pairs_connect(spark, homes):
    from recordloom.llm.components import components

    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 12)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, n % 5)) for c in centre for n in range(12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(simhash.near_links(df, homes=homes)).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_components_of_long_chains(spark):
    from recordloom.llm.components import components

    n = 300
    links = spark.createDataFrame([(i * 37 % n, (i + 1) * 37 % n) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_simhash_odd(odd, none):
    out = [r.asDict() for r in simhash.simhash_components(odd).collect()]
    assert len(out) == odd.count()
    want = brute.simhash(with_ids(odd))
    assert picked([r for r in out if r["doc_id"]], "doc_id", "fingerprint", "component_id") == want
    assert want[12] == want[1] and want[4][1] == 3
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 3, 6, 10}
    assert simhash.simhash_components(none).count() == simhash.drop_near_copies(none).count() == 0


# 6


def check_packed(out, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reader.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids = np.array(reader.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for k, p in enumerate(sorted(pieces[key], key=lambda p: p["piece"])):
            part = ids[at : at + p["length"]].tobytes()
            assert (p["piece"], p["start"], p["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert k == 0 or p["length"] == 2048
            at += p["length"]
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing(spark, rows):
    out = run(spark, "op6_packing")
    n = check_packed(out, {r["doc_id"]: r["text"] for r in rows})
    assert n <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_packing_in_rounds(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [r.asDict() for r in packing.pack_pieces(docs, group_pieces=10).collect()]
    n = check_packed(out, {r["doc_id"]: r["text"] for r in rows})
    assert n <= 1.05 * -(-sum(r["length"] for r in out) // 2048)  # groups of ten pieces


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for sizes in ([6, 6, 6, 4, 4, 4], [7, 7, 7], [10], [], *[rng.integers(1, 11, 30).tolist() for _ in range(20)]):
        sizes = np.array(sizes, dtype=np.int64)
        bins, offset, n = packing.best_fit_decreasing(sizes, 10)
        held = np.bincount(bins, weights=sizes, minlength=n)
        assert (held <= 10).all() and len(set(zip(bins.tolist(), offset.tolist(), strict=True))) == len(sizes)
        assert -(-sizes.sum() // 10) <= packing.lower_bound(sizes, 10) <= n
    assert packing.lower_bound(np.array([6, 6, 6, 4, 4, 4]), 10) == 3 and packing.lower_bound(np.array([7, 7, 7]), 10) == 3


def test_packing_reads_added_tokens(make):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", mark, f"{mark}{mark} x", f"one  {mark}  two\n\n{mark}", "<|endoftext|", "<|endof<|endoftext|>text|>", f"é {mark.upper()} {mark}ü"]
    assert reader.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    out = {r.doc_id: r for r in packing.pack_pieces(make(*[(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        ids = np.array(reader.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert (out[i].length, out[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_odd(odd, none):
    out = [r.asDict() for r in packing.pack_pieces(odd).collect()]
    by = Counter(r["doc_id"] for r in out)
    assert by[10] == 2 and by[None] == 2 and by[6] > 20
    assert packing.pack_pieces(none).count() == 0


# 7


def check_shards(out, texts, shards=24):
    slots, held = defaultdict(list), Counter()
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return held


def test_sharding(spark, rows):
    out = run(spark, "op7_sharding")
    held = check_shards(out, {r["doc_id"]: r["text"] for r in rows})
    mean, largest = sum(held.values()) / 24, max(r["size"] for r in out)
    assert len(out) == len(rows) and all(abs(b - mean) <= largest for b in held.values())


def test_sharding_splits_one_source(make):
    docs = make(*[(i, "x" * (20 + i % 11), "en", "hot") for i in range(2400)])
    out = [r.asDict() for r in sharding.shard(docs, numeric=(), block_rows=32).collect()]
    held = check_shards(out, {i: "x" * (20 + i % 11) for i in range(2400)})
    assert max(held.values()) < 1.05 * min(held.values())


def test_sharding_odd(odd, none):
    out = sharding.shard(odd).collect()
    assert len(out) == odd.count() and {r.law for r in out} == {"bytes"}
    assert sharding.shard(none).count() == 0


# 8


def test_warc(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    got = picked(run(spark, "op8_warc"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.payloads(rows)


def test_warc_with_magic_in_payloads_and_splits(spark, tmp_path):
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, None if i % 7 == 0 else f"http://h/ {i}\r\n", ("ü" * (i % 50) + fake * (i % 4) + "WARC/1.1\r\n" * (i % 3)) if i % 11 else None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(3), str(tmp_path / "a"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = [r.asDict() for r in warc.page_records(spark, str(tmp_path / "a")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = brute.payloads([{"page_id": r[0], "html": r[2]} for r in rows])
    assert picked(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want and len(out) == len(rows)


def test_warc_with_long_urls(spark, tmp_path):
    rows = [(i, f"http://h/{i}?" + "q " * (100_000 if i in (0, 7) else 3), f"page {i % 5}") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    out = [r.asDict() for r in warc.page_records(spark, str(tmp_path / "a")).collect()]
    want = brute.payloads([{"page_id": r[0], "html": r[2]} for r in rows])
    assert picked(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want and len(out) == len(rows)


@pytest.mark.parametrize("damage", [lambda data: data[:-40], lambda data: data.replace(b"Content-Length", b"Content-Longth", 3), lambda data: b"x" + data])
def test_warc_broken_files_raise(spark, tmp_path, damage):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    (path,) = (tmp_path / "a").glob("part-*")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.warc").write_bytes(damage(path.read_bytes()))
    with pytest.raises(ValueError, match="one.warc"):
        warc.page_records(spark, str(tmp_path / "b"))


def test_warc_odd(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, None, "x"), (None, "u", "y"), (2, "u", None), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert out == {(1, "response", None): 2, (None, "revisit", 1): 1, (None, "response", None): 1, (2, "revisit", 3): 1, (3, "response", None): 1}
    assert warc.round_trip(pages.limit(0)).count() == 0


# 9


def test_scores(spark, rows):
    out = run(spark, "op9_lm_scoring")
    want = brute.unigram(rows)
    assert picked(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == {k: v[:4] for k, v in want.items()}
    assert all(r["base_score"] == pytest.approx(want[r["doc_id"]][4]) and r["score"] < 0 for r in out)


def test_spelled_chances_sum_to_one_at_most():
    words = [b"abab", b"abba", b"b", b"aab"] * 5
    tables = lm_scoring.empty_tables()
    lm_scoring.count_bits(tables, [*words, b""], np.ones(len(words) + 1))
    model = lm_scoring.fit_mixer(tables, words)
    letters = [bytes([c]) for c in range(256) if c != 0x20]
    one = 10.0 ** lm_scoring.log10_words(model, [b"", *letters])
    assert 0 < one.sum() <= 1 + 1e-9
    # All that begins with a letter, and the end, is everything.
    data, starts, contexts = lm_scoring._symbols(letters)
    first = np.ones(len(letters))
    for slots, bit in lm_scoring._slots(data, contexts):
        p = lm_scoring._predict(model, *lm_scoring._inputs(tables, slots, None))[starts]
        first *= np.where(bit[starts] == 1, p, 1 - p)
    assert first.sum() + one[0] == pytest.approx(1, abs=1e-6)


def test_frequent_list_does_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    few = picked([r.asDict() for r in lm_scoring.score(docs, frequent=10, sample=500).collect()], "doc_id", "score", "base_score", "n_known")
    many = picked([r.asDict() for r in lm_scoring.score(docs, sample=500).collect()], "doc_id", "score", "base_score", "n_known")
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k]) for k in few)


def test_scores_beat_the_base_on_held_out_text(spark):
    out = [r for r in entry.queries()["op9_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("frequent", [1, 1 << 18])
def test_scores_of_long_unseen_words(make, frequent):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    long = ["q7Zk" * n for n in (50, 500, 2500)]
    docs = make(*[(i, f"some plain words {i % 9}", "en" if i % 2 else "de", "s") for i in range(200) if i not in held], *zip(held, long, "eee", "sss"))
    out = {r.doc_id: r for r in lm_scoring.score(docs, frequent=frequent, sample=500).collect()}
    # Every byte costs: ten times as long a word is at least some five times as unlikely.
    scores = [out[i].score for i in held[:3]]
    assert scores[0] < -50 and scores[1] < 5 * scores[0] and scores[2] < 3 * scores[1] and scores[2] > -float("inf")
    assert all(out[i].bits_per_byte > 1 for i in held[:3])


def test_weights_are_fitted_on_all_training_words(spark):
    words = sorted({f"{a}{b}{c}".encode() for a in ("un", "re", "") for b in ("do", "make", "tie", "read") for c in ("s", "er", "ing", "")})
    counts = spark.createDataFrame([(bytearray(w), 1) for w in words] + [(bytearray(b"held"), 0)], "word binary, c long")
    one, many = lm_scoring.train(counts), lm_scoring.train(counts, sample=5)
    assert one.seen.sum() == many.seen.sum() == 2 * 8 * sum(len(w) + 1 for w in words)
    # A run of all words is the fit itself.
    order = {r.word: r.h for r in counts.selectExpr("word", "xxhash64(word) as h").collect()}
    direct = lm_scoring.fit_mixer(one.tables, sorted(words, key=lambda w: (order[w], w)))
    assert one.weights == pytest.approx(direct.weights) and one.refined == pytest.approx(direct.refined)
    assert (many.weights != lm_scoring.fit_mixer(one.tables, []).weights).any()


def test_long_words_are_spelled_in_parts(monkeypatch):
    words = [b"abab", b"abba" * 300, b"", b"aab"] * 5
    weight, tables = np.arange(1, 21), [lm_scoring.empty_tables() for _ in range(2)]
    lm_scoring.count_bits(tables[0], words, weight)
    model = lm_scoring.fit_mixer(tables[0], words)
    whole = lm_scoring.log10_words(model, words)
    seen, slots = [], lm_scoring._slots
    monkeypatch.setattr(lm_scoring, "SPELL_BYTES", 100)
    monkeypatch.setattr(lm_scoring, "_slots", lambda data, contexts: seen.append(len(data)) or slots(data, contexts))
    lm_scoring.count_bits(tables[1], words, weight)
    assert all((a == b).all() for a, b in zip(*tables, strict=True))
    assert lm_scoring.log10_words(model, words) == pytest.approx(whole) and max(seen) <= 100


def test_scores_know_the_order_of_words(make):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    text = "north wind and bright sun argued over who of both was stronger"
    other = "sun wind stronger both bright of and was who over argued north"
    docs = make(*[(i, " ".join([text] * 3), "en", "s") for i in range(300) if i not in held], *zip(held, (text, " ".join(reversed(text.split())), other), "eee", "sss"))
    out = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    first, *others = (out[i] for i in held)
    assert all(r.base_score == pytest.approx(first.base_score) and r.score < first.score - 3 for r in others)


def _learned(symbols, counts):
    learner = lm_words.Learner(lm_words.prefix_code(np.array(counts)))
    for _ in range(5):
        learner.learn(symbols)
    return lm_words.Mixer(learner.code, learner.pairs(), learner.sums())


def test_code_of_words_has_their_share():
    counts = np.array([3, 1, 40, 20, 9, 5, 2, 2])
    code = lm_words.prefix_code(counts)
    assert sum(2.0 ** -code.length) == 1
    for symbol, n in enumerate(counts):
        at = slice(code.first[symbol], code.first[symbol] + code.length[symbol])
        one = 1 / (1 + np.exp(-code.odds[at].astype(float)))
        assert np.prod(np.where(code.bits[at] > 0, one, 1 - one)) == pytest.approx(n / counts.sum(), rel=1e-5)


def test_chances_of_the_next_word_sum_to_one():
    symbols = np.array([2, 3, 4, 5, 0, 3, 4, 5, 1, 0, 2, 3, 4, 0] * 30)
    mixer = _learned(symbols, np.bincount(symbols))
    for before in ([], [2], [2, 3], [5, 1], [4, 5]):
        chances = [10 ** mixer.log10_symbols(np.array([*before, s]))[-1] for s in range(6)]
        assert sum(chances) == pytest.approx(1, abs=1e-5)
    after = [10 ** mixer.log10_symbols(np.array([*before, 4]))[-1] for before in ([2, 3], [4, 5])]
    assert after[0] > 0.9 and after[1] < 0.1


def test_contexts_end_with_the_text():
    symbols = np.array([2, 3, 4, 0, 3, 4, 5, 0, 2, 5, 0] * 20)
    mixer = _learned(symbols, np.bincount(symbols) + 1)
    texts = [np.array(t) for t in ([2, 3, 4, 0], [0], [3, 0], [5, 5, 2, 3, 4, 0])]
    assert mixer.log10_symbols(np.concatenate(texts)) == pytest.approx(np.concatenate([mixer.log10_symbols(t) for t in texts]))


def test_beginnings_of_words_are_looked_up_once():
    words = [b"walk", b"walks", b"walked", b"talk", b""] * 3
    data, starts, contexts = lm_scoring._symbols(words)
    once, of_once, which = lm_scoring._distinct(data, contexts)
    assert (once[which] == data).all() and (of_once[:, which] == contexts).all()
    assert len(once) == len({(w + b" ")[: i + 1] for w in words for i in range(len(w) + 1)})


def test_symbols_after_the_same_words_are_predicted_once(monkeypatch):
    text = np.array([2, 3, 4, 5, 1, 3, 0])
    mixer = _learned(text, np.bincount(text) + 1)
    want, seen, ones = mixer.log10_symbols(text), [], mixer.ones
    monkeypatch.setattr(mixer, "ones", lambda odds, slots: seen.append(len(odds)) or ones(odds, slots))
    assert (mixer.log10_symbols(np.tile(text, 50)) == np.tile(want, 50)).all()
    assert sum(seen) == mixer.code.length[text].sum()


def test_symbols_of_texts_are_those_of_their_words():
    texts = [" a b ", "", None, "Ünï ÀB\x0bc\x1cd\x85e f", "\n\t", "x", "É  q\x00r\r\nB"]
    split = [(t or "").encode().lower().split() for t in texts]
    place = {b"b": 2, b"q\x00r": 3}
    for i in range(len(texts) + 1):
        symbols, begin, words, at = lm_scoring._symbols_of(pa.array(texts, pa.string()).slice(i), pa.array([*place], pa.binary()))
        assert symbols.tolist() == [s for w in split[i:] for s in [*(place.get(x, lm_words.OTHER) for x in w), lm_words.END]]
        assert np.diff(begin, append=len(symbols)).tolist() == [len(w) + 1 for w in split[i:]]
        assert words.to_pylist() == [x for w in split[i:] for x in w] and (symbols[np.setdiff1d(np.arange(len(symbols)), at)] == lm_words.END).all()


def test_scores_odd(odd, none):
    out = lm_scoring.score(odd).collect()
    assert len(out) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in out)
    assert lm_scoring.score(none).count() == 0


# 10


def test_language(spark):
    out = entry.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_kernel_is_the_mean_of_normalised_intersections():
    texts = [b"abcd xyz", b"bcd abc", b"zz"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    x = language_id.normalised(language_id.presence(data, offsets))

    def grams(t, n):
        t = t + b""
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = np.mean([len(grams(a, n) & grams(b, n)) / max(1, len(grams(a, n)) * len(grams(b, n))) ** 0.5 for n in (2, 3, 4)])
            assert float(x[i] @ x[j]) == pytest.approx(want, abs=1e-5)


def test_language_odd(odd, none):
    out = language_id.identify(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[3] == by[4] == by[5] == "und" and by[11] != "und"
    assert language_id.identify(none).count() == 0


# odd urls, repeated rows


@pytest.mark.parametrize("mark", ["\u2028", "\u2029", "\x85", " ", "\r\n", "\n", "\x0b", "\xe9", "\U0001f600", "%41", "+"])
def test_warc_urls_of_any_characters(spark, tmp_path, mark):
    urls = [f"http://b/{mark}Content-Length:3", f"http://b/{mark}WARC-Refers-To:<urn:page:1>{mark}", f"{mark}{mark}", None]
    rows = [(i, u, "same" if i > 1 else f"<p>{mark}WARC/1.1\r\n{i}") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = picked([r.asDict() for r in warc.round_trip(pages).collect()], "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert out == brute.payloads([{"page_id": i, "html": t} for i, _, t in rows])
    warc.write_archives(pages, str(tmp_path / "w"))
    headers = [r.header for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    assert all(h.isascii() and len(h.split("\r\n")) in (7, 9) for h in headers)


def test_warc_text_ids_come_back(spark):
    ids = ["a b", "a+b", "é/<>\n", "", None, "none", "%20"]
    pages = spark.createDataFrame([(i, "u", f"p{n // 2}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    out = warc.round_trip(pages).collect()
    # An empty id is written like none.
    assert Counter(r.page_id for r in out) == Counter(i or None for i in ids)


def test_sharding_splits_repeated_rows(spark):
    rows = [(7, "x" * 40, "s", "en")] * 1000 + [(i, "y" * 40, "t", "en") for i in range(100, 2100)] + [(None, "z" * 40, None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    out = sharding.shard(docs).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 3 * 48
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    again = sharding.shard(docs.repartition(3)).collect()
    assert Counter(tuple(r)[:-2] for r in out) == Counter(tuple(r)[:-2] for r in again)


def test_language_sample_of_repeated_rows(spark):
    rows = [(1, "guten tag und hallo", "de")] * 400 + [(i, f"good day number {i}", "en") for i in range(2, 900)] + [(None, "no id", "fr")] * 50
    rows += [(5000, "two texts a", "de"), (5000, "two texts b", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    bits, languages = language_id.training_sample(docs, "doc_id", "text", "lang", 400)
    learned = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    want = Counter({"de": len(learned & {1, 5000}), "en": min(400, len(learned - {1, 5000}))})
    assert Counter(languages.tolist()) == +want and len(bits) == len(languages)


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_SAMPLE", 30)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 10)
    rows = [(i, f"text {i}", f"l{i % (1 + i % 25)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, languages = language_id.training_sample(docs, "doc_id", "text", "lang", 400)
    assert len(set(languages.tolist())) == 10 and set(Counter(languages.tolist()).values()) == {3}
