"""Ranked search, n-gram Jaccard join and importance resampling against plain Python."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from recordloom.llm import importance, jaccard, lexical_search
from recordloom.llm.crc import run_sums
from recordloom.llm.terms import line_pack, term_pack

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def asked(spark):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    """Items with nulls, without terms, repeated, with extra columns named like ours."""
    full = [(1, "same row"), (2, None), (None, "a b C"), (4, " .,; "), (5, ""), (6, "same row"), (6, "same row"), (7, "ÜNÏCODE wörds à")]
    names = "item_id long, text string, doc_id long, score long, `rank` int, _id string, _item string"
    return spark.createDataFrame([(*r, 3, 4, 5, "x", "y") for r in full], names)


def test_terms_and_lines_are_those_of_the_pattern(rows):
    texts = [r["text"] for r in rows[:50]] + ["", None, "A\n\nb c\n.\nd", "\n", "Ünï x Y\x7fz", "no end\n"]
    words = term_pack(pa.array(texts))
    data = words.text()
    got = [data[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert [got[a:b] for a, b in zip(words.first[:-1], words.first[1:])] == [brute.terms(t) for t in texts]
    lines, of = line_pack(pa.array(texts))
    data = lines.text()
    got = [data[a:b].decode() for a, b in zip(lines.starts, lines.ends)]
    want = [(i, brute.terms(line)) for i, t in enumerate(texts) for line in (t or "").split("\n") if brute.terms(line)]
    assert [(i, got[a:b]) for i, a, b in zip(of.tolist(), lines.first[:-1], lines.first[1:])] == want


# 11


def found(df, items):
    """Rows by the place of their item; items with one id and text have the same rows."""
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def wanted(rows, items, k=10):
    return Counter((items[i]["item_id"], rank, doc, score) for i, rank, doc, score in brute.search(rows, [x["text"] for x in items], k))


def test_search(spark, rows, asked):
    assert found(entry.queries()["op11_lexical_search"](spark, FOLDER), asked) == wanted(rows, asked)


@pytest.mark.parametrize("sizes", [(30, 200, 2000), (1, 1, 1), (1 << 20, 1 << 21, 50)])
def test_blocks_and_tiles_do_not_matter(spark, rows, asked, sizes):
    docs, items = spark.createDataFrame(rows[:60]), asked[:6]
    block, item_cells, doc_cells = sizes
    out = lexical_search.search(docs, spark.createDataFrame(items), 4, block_terms=block, item_cells=item_cells, doc_cells=doc_cells)
    assert found(out, items) == wanted(rows[:60], items, 4)


def test_search_ties_go_to_the_smallest_ids(spark):
    docs = [{"doc_id": i, "text": "red fox" if i % 3 else "a blue cat"} for i in random.Random(3).sample(range(300), 300)]
    items = [{"item_id": 1, "text": "Fox"}, {"item_id": 2, "text": "blue! cat, cat"}]
    df = spark.createDataFrame(docs).repartition(7)
    out = lexical_search.search(df, spark.createDataFrame(items), doc_cells=64)
    assert found(out, items) == wanted(docs, items)
    assert [r.doc_id for r in out.filter("item_id = 2").orderBy("rank").collect()] == list(range(0, 30, 3))


def test_products_are_cut_before_they_lose_a_bit():
    rng = np.random.default_rng(5)
    weights, impacts = rng.integers(1 << 30, 1 << 31, (3, 40)), rng.integers(999_000, 1_000_000, (40, 5))
    exact = [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in impacts.T] for row in weights]
    assert max(map(max, exact)) > 1 << 53
    assert lexical_search.tile_scores(weights.astype(float), impacts.astype(float)).tolist() == exact


def test_long_documents_do_not_overflow_their_length():
    n = np.array([10**9, 7], dtype=np.int64)
    assert lexical_search._lengths(n, 10**11, 10**13).tolist() == [10 + 90 * 10**9 * 10**11 // 10**13, 10 + 90 * 7 * 10**11 // 10**13]


def test_search_odd(odd, none, items):
    rows, asked = [r.asDict() for r in odd.collect()], [r.asDict() for r in items.collect()]
    got = found(lexical_search.search(odd, items), asked)
    assert got == wanted(rows, asked)
    assert {i for i, *_ in got} == {None, 1, 6, 7} and got[(6, 1, 10, next(s for i, n, d, s in got if (i, n, d) == (6, 1, 10)))] == 2
    assert lexical_search.search(none, items).count() == lexical_search.search(odd, items.limit(0)).count() == 0
    assert lexical_search.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]


# 12


def joined(out, rows):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


def should_join(rows):
    return Counter((r["doc_id"], *v) for r, v in zip(rows, brute.jaccard(rows).values()))


def test_jaccard(spark, rows):
    assert joined(entry.queries()["op12_ngram_jaccard_join"](spark, FOLDER), rows) == should_join(rows)


def changed(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), min(n, len(words))):
        words[i] = f"x{rng.random()}"
    return words


def near_copies(rng, passage):
    """Texts of all lengths with copies just above and below the threshold, chains, and one passage in most of them."""
    texts = []
    for size in (1, 2, 3, 8, 10, 11, 12, 13, 14, 30, 40, 100, 200, 400):
        words = [f"w{rng.randrange(50 * size)}" for _ in range(size)]
        texts.append(words)
        for _ in range(6):
            texts.append(changed(words, rng.randrange(1 + size // 28), rng))
        chain = words
        for _ in range(4):
            chain = changed(chain, max(1, size // 90), rng)
            texts.append(chain)
        texts += [words[1:], words[:-1], [*words, "z"], ["z", *words], words[: size // 2] * 2, words]
    texts += [passage + [f"t{i}.{j}" for j in range(rng.randrange(1, 12))] for i in range(40)]
    texts += [[f"u{i}.{j}" for j in range(60)] + passage for i in range(30)]
    rng.shuffle(texts)
    return [{"doc_id": i, "text": " ".join(t)} for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "held", "passing"), [(1, 1 << 12, 1 << 16), (2, 1, 2), (3, 3, 5)])
def test_jaccard_finds_every_link_of_near_copies(spark, seed, held, passing, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 2 if seed == 2 else 1 << 12)
    monkeypatch.setattr("recordloom.llm.hot.HOT", 5 if seed == 2 else 4096)
    monkeypatch.setattr(jaccard, "SMALL_GRAPH", 3 if seed == 3 else 1 << 20)
    monkeypatch.setattr(jaccard, "HUB_TURNS", 1 if seed == 2 else 4)
    rng = random.Random(seed)
    rows = near_copies(rng, [f"p{i}" for i in range(80)])
    want = should_join(rows)
    assert len({c for _, _, c in want}) < len(rows) - 60
    out = jaccard.jaccard_components(spark.createDataFrame(rows).repartition(5), held=held, passing=passing)
    assert joined(out, rows) == want


def test_prefixes_of_linked_sets_share_what_is_said():
    """Over all sizes: the worst split of the shared shingles still leaves as many in both prefixes, and one in a list."""
    for n in range(1, 700):
        for m in range(n, 700):
            common = -(-90 * (n + m) // 190)
            if common > n:
                break
            sure = min(int(jaccard.surely_shared(n)), int(jaccard.surely_shared(m)))
            # The place of the sure-th shared shingle when all that is not shared comes before it.
            for size in (n, m):
                assert size - common + sure <= jaccard.prefix_length(size)
                assert jaccard.left_out(size) < sure


def test_jaccard_bitmaps_never_differ_more_than_the_sets(rows):
    hashes, upto = jaccard._shingle_sets(pa.array([r["text"] for r in rows]), 3)
    bits = jaccard._bitmaps(hashes, upto)
    for a in range(0, 60):
        for b in range(a):
            x, y = set(hashes[upto[a] : upto[a + 1]].tolist()), set(hashes[upto[b] : upto[b + 1]].tolist())
            assert np.bitwise_count(bits[a] ^ bits[b]).sum() <= len(x ^ y)


def test_jaccard_odd(odd, none):
    rows = [r.asDict() for r in odd.collect()]
    out = jaccard.jaccard_components(odd)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert joined(out, rows) == should_join(rows)
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert by_id[12].component_id == 1 and by_id[4].component_id == 4 and by_id[5].n_shingles == 0
    assert jaccard.jaccard_components(none).count() == 0


# 13


def test_run_sums_are_those_of_the_bytes():
    rng = random.Random(9)
    sizes = [1, 2, 3, 5, 23, 24, 25, 26, 62, 63, 64, 65, 127, 128, 200, 5000, 70_000]
    words = ["".join(rng.choice("abcé9") for _ in range(rng.choice(sizes))) for _ in range(120)]
    pack = term_pack(pa.array([" ".join(words)]))
    for n, sums in enumerate(run_sums(pack, 3), 1):
        assert sums.tolist() == [zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)]


def test_resample(spark, rows, asked):
    out = [tuple(r) for r in entry.queries()["op13_importance_resampling"](spark, FOLDER).collect()]
    assert Counter(out) == Counter(brute.resample(rows, [a["text"] for a in asked]))


def test_features_over_lines(spark):
    texts = ["a b\nc\nd", "a b\nc\nd\na b", "\n\n a b \n", "c", None, "", "x", "A B. c\r\nd\n\n\n.\n e f g h i"]
    df = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    got = {r.bucket: r.n for r in importance.feature_counts(df).collect()}
    assert got == dict(brute.run_counts(texts))


def test_resample_ranks_in_parts(spark):
    rng = random.Random(4)
    rows = [{"doc_id": i, "text": " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15, 60)))} for i in range(800)]
    rows += [{"doc_id": 9000, "text": "a b c d e f g h " * 4}] * 400
    out = importance.resample(spark.createDataFrame(rows).repartition(6), spark.createDataFrame([("a b c a b",)], "text string"), percent=60)
    want = brute.resample(rows, ["a b c a b"], percent=60)
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(want)
    drawn = sorted(r[4] for r in got if r[4])
    assert drawn == list(range(1, len(drawn) + 1))


def test_resample_odd(odd, none, items):
    rows, target = [r.asDict() for r in odd.collect()], [r.text for r in items.collect()]
    out = importance.resample(odd, items)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in out.collect()) == Counter(brute.resample(rows, target))
    assert Counter(tuple(r) for r in importance.resample(odd, none).collect()) == Counter(brute.resample(rows, []))
    assert importance.resample(none, items).count() == importance.draw(none, items).count() == 0
    kept = importance.draw(odd, items, percent=50)
    assert kept.columns == odd.columns
    want = [r[0] for r in brute.resample(rows, target, percent=50) if r[4]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
