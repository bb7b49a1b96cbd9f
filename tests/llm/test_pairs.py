"""Exact, SimHash and embedding duplicates against brute force, with odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardwatch.llm import exact, simhash, vectors
from wardwatch.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, row long, fp string"
BLANK = " \t\n\v\f\r"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 7, "clash") for i, t in rows], DOCS).repartition(3)


def odd_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "B", "cd", "é", "　x"]) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(200 + i, "same  text" if i % 2 else "same text") for i in range(80)]
    rows += [(None, None), (None, ""), (300, " \n"), (301, "z" * 200_000), (302, "z" * 200_000 + " "), (303, None), (7, "twice"), (7, "twice")]
    return rows


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def bare(text):
    return "".join(c for c in text or "" if c not in BLANK)


@pytest.mark.parametrize("bits,bucket_keys", [(64, 65_536), (64, 4), (2, 4)])
def test_exact_duplicates(spark, bits, bucket_keys):
    rows = odd_rows()
    hasher = (lambda t: F.xxhash64(t)) if bits == 64 else (lambda t: F.shiftleft(F.xxhash64(t), 64 - bits))
    found = exact.duplicates(docs_of(spark, rows), hasher=hasher, bucket_keys=bucket_keys).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((len(t or ""), i))
    kept = {}
    for r in found:
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
    want = []
    for i, t in rows:
        group = groups[bare(t)]
        best = min(group, key=lambda g: (-g[0], g[1] is None, g[1] or 0))
        want.append((i, best[1], len(group), hashlib.sha256(bare(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=key) == sorted(want, key=key)
    assert all(sum(k) == 1 for k in kept.values()) and len(kept) == len(groups)


@pytest.mark.parametrize("hasher", [lambda t: F.xxhash64(t), lambda t: F.length(t).cast("long"), lambda t: F.lit(7).cast("long")])
def test_bytes_decide_and_not_digests(spark, hasher):
    """All texts share one digest, and some or all share a hash: sizes and winners still follow the texts."""
    rows = odd_rows()
    found = exact.duplicates(docs_of(spark, rows), hasher=hasher, digest=lambda t: F.lit("same")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((len(t or ""), i))
    want = []
    for i, t in rows:
        group = groups[bare(t)]
        want.append((i, min(group, key=lambda g: (-g[0], g[1] is None, g[1] or 0))[1], len(group), "same"))
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found) == sorted(map(str, want))
    assert sum(r["kept"] for r in found) == len(groups)
    kept = exact.deduplicated(docs_of(spark, rows), hasher=hasher, digest=lambda t: F.lit("same")).collect()
    assert sorted(bare(r["text"]) for r in kept) == sorted(groups)


def test_directory_doubles_until_buckets_fit_and_chains_what_cannot_be_split(spark):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(400)])
    index = exact.build_index(docs, bucket_keys=16)
    sizes = [r["count"] for r in index.entries.groupBy("bucket").count().collect()]
    assert max(sizes) <= 16 and sum(sizes) == 400 and 5 <= index.depth <= 10
    assert index.directory.count() <= 2**index.depth
    weak = exact.build_index(docs, hasher=lambda t: F.shiftleft(F.xxhash64(t), 62), bucket_keys=16)
    assert sorted(r["chain"] for r in weak.entries.where("h = 0").collect()) == list(range(weak.entries.where("h = 0").count()))
    assert weak.entries.count() == 400


def test_exact_stage_returns_whole_rows_and_one_of_repeated_rows(spark):
    docs = docs_of(spark, odd_rows())
    out = exact.deduplicated(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len({bare(t) for _, t in odd_rows()}) and sum(r["text"] == "twice" for r in rows) == 1
    assert exact.deduplicated(docs.limit(0)).count() == 0 and exact.duplicates(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rng = random.Random(3)
    words = [f"w{i}É" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(8):
            text = list(base)
            for _ in range(k // 2):
                text[rng.randrange(300)] = "Changed"
            rows.append((1000 - len(rows), " ".join(text)))
    return rows + odd_rows()


def test_fingerprints_and_components(spark):
    rows = near_rows()
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = union_find(len(rows), pairs)
    lowest = {}
    for r, (i, _) in zip(roots, rows):
        lowest[r] = min(x for x in (lowest.get(r), i, 10**9) if x is not None)
    want = sorted((str(i), f"{p:016x}", lowest[r] if lowest[r] < 10**9 else None) for (i, _), p, r in zip(rows, prints, roots))
    docs = docs_of(spark, rows)
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert found == want
    kept = simhash.one_per_group(docs)
    assert kept.schema == docs.schema and kept.count() == len(set(roots))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(v for v in lowest.values() if v < 10**9)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_per_group(docs.limit(0)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(3)]
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(3000):
        different = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & different == 0 for m in masks)


def test_large_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(2)
    base = 0x0123456789ABCDEF
    prints = {base}
    while len(prints) < 300:
        value = int(rng.choice(list(prints)[-20:])) if rng.random() < 0.7 else base
        for b in rng.integers(0, 63, rng.integers(1, 5)):
            value ^= 1 << int(b)
        prints.add(value)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.fingerprint_links(frame, tile=16).collect()
    at = {p: i for i, p in enumerate(prints)}
    brute = [(i, j) for i in range(300) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert union_find(300, [(at[r["a"]], at[r["b"]]) for r in links]) == union_find(300, brute)


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 400)}


def cloud():
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=64) for _ in range(150)]
    for g in range(10):
        base = rng.normal(size=64)
        rows += [base + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.33]) for _ in range(12)]
    rows += [rows[0] * 3, rows[0] * 1e-200, rows[1].copy(), rows[1].copy()]
    return [list(map(float, r)) for r in rows]


@pytest.mark.parametrize("tile,dimensions", [(8192, 16), (20, 16), (50, 4)])
def test_links_of_vectors(spark, tile, dimensions):
    given = cloud()
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 0.0], [1.0, 0.05]]
    rows = [(900 - i, v, 1, "x") for i, v in enumerate(given + odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.similar(frame, tile=tile, dimensions=dimensions).collect()}
    x = np.array(given)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in np.argwhere(x @ x.T >= 0.9) if i < j] + [(len(given) + 6, len(given) + 7)]
    roots = union_find(len(rows), pairs)
    ids = [r[0] for r in rows]
    lowest, links = {}, [0] * len(rows)
    for i, r in enumerate(roots):
        lowest[r] = min(lowest.get(r, 10**9), ids[i])
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert found == {ids[i]: (links[i], lowest[roots[i]], ids[i] == lowest[roots[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("tile", [8192, 12])
def test_cells_along_several_axes_leave_out_most_pairs(spark, tile, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(700, 3)), rng.normal(size=(700, 5)) * 0.01], axis=1)
    x[600:] = x[:100] + rng.normal(size=(100, 8)) * 0.03
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = []
    plain = vectors.worth_it

    def told(counts):
        asked.append((counts, plain(counts)))
        return asked[-1][1]

    monkeypatch.setattr(vectors, "worth_it", told)
    found = {r["vec_id"]: r["n_links"] for r in vectors.similar(frame, cosine=0.99, dimensions=8, tile=tile).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.99).sum(axis=1) - 1
    assert found == dict(enumerate(near.tolist())) and near.sum() > 500
    counts, pruned = asked[0]
    assert pruned == {8: [0]} and vectors.planned_pairs(counts[8][0]) < 700 * 699 / 2 / 10


def test_neighbours_meet_once():
    cells = [(x, y) for x in range(4) for y in range(4)]
    pairs = [frozenset([c, o]) for c in cells for o in vectors.neighbours(c) if o in cells]
    assert len(pairs) == len(set(pairs)) == sum(max(abs(a - c), abs(b - d)) == 1 for a, b in cells for c, d in cells) / 2
    assert vectors.planned_pairs({(0, 0): 3, (1, 1): 2, (3, 3): 5}) == 3 + 1 + 6 + 10


def test_vectors_of_an_empty_table_or_without_any_direction(spark):
    frame = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, vectors.similar(frame).collect())) == [
        "Row(vec_id=1, n_links=0, component_id=1, kept=True)", "Row(vec_id=None, n_links=0, component_id=None, kept=False)",
    ]
    assert vectors.similar(frame.limit(0)).count() == 0
