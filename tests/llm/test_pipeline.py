"""The pipeline stage by stage against plain versions, on documents with nulls, empty texts and repeated rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_pairs import bare, plain_fingerprint, union_find
from test_rows import mixed_plain, quality_rows, whole_ids

import corpus_pipeline
from wardwatch.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Labelled documents, copies, near copies, and rows with nulls in every column."""
    rng = random.Random(11)
    rows, labels = quality_rows(rng, 260)
    made = [(i, t, rng.choice(["en", "de", None]), f"host{i % 3}") for i, t, *_ in rows]
    good = [r[1] for r in made if "SPAM" not in r[1]][:12]
    made += [(300 + k, t.replace(" ", "  " if k % 2 else "\n", 3), "en", "host1") for k, t in enumerate(good)]  # copies but for white space
    made += [(400 + k, t + " appendix", "en", "host2") for k, t in enumerate(good)]  # near copies
    made += [(500, None, "en", "host0"), (501, "", None, None), (502, " \n", "en", "host0"), (None, None, None, None), (None, good[0], "en", None)]
    made += [made[7], made[7], (503, "lone", "en", None)]
    labels += [(None, 1, 0), (5, None, None), (9999, 1, 0)]
    return made, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs, labels = corpus()
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in docs], DOCS).repartition(3)
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def handed(spark, folder):
    """What each stage got and gave, as rows, and the schemas."""
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
        steps.append((name, docs, out, [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]))
        docs = out
    return {s[0]: s[1:] for s in steps}


def test_stages_keep_the_columns_of_documents(handed):
    assert list(handed) == ["quality_classifier", "exact_dedup", "simhash_dedup", "source_mix", "best_fit_packing"]
    for name, (before, after, _, _) in handed.items():
        if name != "best_fit_packing":
            assert after.schema == before.schema


def test_quality_stage_drops_what_the_posterior_rejects(spark, folder, handed):
    _, _, given, kept = handed["quality_classifier"]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    verdicts = quality.judged(docs, labels).select("doc_id", "host", "lang", "mark", "kept")
    marks = docs.select("doc_id", F.col("source").alias("host"), "lang", F.xxhash64("doc_id", "text").alias("mark"), "text", "source", "n_chars").collect()
    good = {(v["doc_id"], v["host"], v["lang"], v["mark"]) for v in verdicts.collect() if v["kept"]}
    want = [(m["doc_id"], m["text"], m["lang"], m["source"], m["n_chars"]) for m in marks if (m["doc_id"], m["host"], m["lang"], m["mark"]) in good]
    assert Counter(kept) == Counter(want) and 0 < len(kept) < len(given)
    assert Counter(kept)[tuple(r for r in given if r[0] == 7)[0]] in (0, 3)  # repeated rows share a verdict


def test_exact_stage_keeps_the_longest_row_of_each_text(handed):
    _, _, given, kept = handed["exact_dedup"]
    groups = {}
    for r in given:
        groups.setdefault(bare(r[1]), []).append(r)
    best = [min((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in rows) for rows in groups.values()]
    assert sorted((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in kept) == sorted(best)
    assert not Counter(kept) - Counter(given)


def test_simhash_stage_keeps_one_row_of_each_component(handed):
    _, _, given, kept = handed["simhash_dedup"]
    prints = [plain_fingerprint(r[1]) for r in given]
    pairs = [(a, b) for a in range(len(given)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    lowest = {}
    for root, r in zip(union_find(len(given), pairs), given):
        lowest[root] = min(lowest.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(lowest.values()) and not Counter(kept) - Counter(given)


def test_mix_stage_meets_its_targets_with_rows_of_its_input(handed):
    _, _, given, taken = handed["source_mix"]
    sizes, targets = mixed_plain([r[:4] for r in given])
    words = Counter()
    for r in taken:
        words[r[3]] += len((r[1] or "").encode().split())
    assert all(abs(words[s] - targets[s]) <= 0.5 for s in targets)
    texts = {}
    for r in given:
        texts.setdefault((r[0], r[2], r[3]), []).append(r[1] or "")
    cut = [r for r in taken if r[1] not in texts[r[0], r[2], r[3]]]
    assert len(cut) <= len(sizes) and all(any(t.startswith(r[1]) for t in texts[r[0], r[2], r[3]]) and r[4] == len(r[1]) for r in cut)


def test_packing_stage_holds_every_token_once(handed):
    _, _, given, pieces = handed["best_fit_packing"]
    columns = handed["best_fit_packing"][1].columns
    rows = [dict(zip(columns, p)) for p in pieces]
    lengths = Counter()
    for r, ids in zip(given, whole_ids([r[1] for r in given])):
        lengths[r[0]] += len(ids) + 1
    found, places = Counter(), {}
    for p in rows:
        found[p["doc_id"]] += p["length"]
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert found == lengths
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(lengths.values()) // 1024) + 2


def test_run_gives_the_rows_of_the_last_stage(spark, folder, handed):
    rows = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    columns = handed["best_fit_packing"][1].columns
    want = Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in (dict(zip(columns, r)) for r in handed["best_fit_packing"][3]))
    assert rows == want


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
