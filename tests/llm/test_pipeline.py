"""The pipeline's stages against plain Python, each on what the one before kept."""

from collections import Counter

import brute

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        if name == "quality_rules":
            # So few labels certify no cutoff: the base rules alone decide.
            assert kept[name] == Counter(r["doc_id"] for r in before if not brute.quality_base(r["text"])[-1])
        if name == "exact_dedup":
            assert kept[name] == Counter(i for i, r in brute.exact(before).items() if r[2])
        if name == "simhash_near_dedup":
            assert kept[name] == Counter(i for i, r in brute.simhash(before).items() if r[1] == i)
        if name == "mixing":
            size, target = brute.targets(before)
            source = {r["doc_id"]: (r["source"], len(brute.words(r["text"]))) for r in before}
            taken = Counter()
            for i, n in kept[name].items():
                assert n <= 3
                taken[source[i][0]] += n * source[i][1]
            assert all(abs(taken[s] - t) <= max(n for x, n in source.values() if x == s) + 1 for s, t in target.items())
        if name == "packing":
            out = [r.asDict() for r in docs.collect()]
            assert set(kept[name]) == {r["doc_id"] for r in before}
            held = Counter()
            for r in out:
                held[r["sequence_id"]] += r["length"]
            assert max(held.values()) <= 2048
        else:
            assert docs.columns == columns


def test_run_equals_its_stages_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
