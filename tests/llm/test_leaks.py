"""Benchmark decontamination against a plain scan of all windows."""

import hashlib
import random
import re

import pytest

from wardwatch.llm import leaks

DOCS = "doc_id long, text string, item_id string, n_words long, items string, row long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def plain(docs, items, width=10):
    windows = []
    for item, text in items:
        words = words_of(text)
        windows += [(item or "", tuple(words[i : i + width])) for i in range(max(1, len(words) - width + 1)) if words]
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "ÄÖ", "x1", "don't", "9", "γ", "É", "_", "tail"]
    say = lambda n: rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    long_one, other = say(40), say(25)
    items = [
        ("b", long_one), ("a", "BETA beta, x1"), ("c", other), ("c", "only γ9 here"), ("d", long_one), (None, "tail tail TAIL tail"),
        ("e", None), ("f", ""), ("g", "--- !!"), ("h", "the rare word"),
    ]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, "Before " + long_one + " after"), (101, other[: len(other) // 2]), (102, None), (103, ""), (104, "the RARE\tword"), (104, "the RARE\tword")]
    docs += [(None, long_one), (105, "…" * 50), (106, ("pad " * 40_000) + long_one + " " + other), (107, "the rare " * 30_000), (9007199254740993, "é" * 10)]
    return docs, items


def made(spark, docs, items):
    full = [(i, t, "clash", -1, "clash", 7) for i, t in docs]
    return spark.createDataFrame(full, DOCS).repartition(3), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_pairs", [1_000_000, 7])
def test_hits_equal_a_plain_scan(spark, block_pairs):
    docs, items = corpus()
    rows = leaks.leaks(*made(spark, docs, items), keep=["doc_id"], block_pairs=block_pairs).collect()
    found = [(r["doc"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows]
    assert sorted(map(str, found)) == sorted(map(str, plain(docs, items)))
    assert all(r["n_hit"] == sum(s["stop"] - s["start"] for s in r["spans"]) for r in rows)
    assert all(a["stop"] < b["start"] for r in rows for a, b in zip(r["spans"], r["spans"][1:]))  # merged


@pytest.mark.parametrize("block_pairs", [1_000_000, 7])
def test_spans_are_removed(spark, block_pairs):
    docs = [(1, "Keep this: the rare WORD, and this."), (2, "clean  text\n"), (3, None), (4, "the rare word"), (5, "«x» the rare word the rare word y")]
    rows = leaks.decontaminated(*made(spark, docs, [("h", "The rare word!")] + corpus()[1][:3]), block_pairs=block_pairs)
    assert rows.columns == [c.split()[0] for c in DOCS.split(", ")]
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert texts == {1: "Keep this: , and this.", 2: "clean  text\n", 3: None, 4: "", 5: "«x»  y"}
    left = leaks.decontaminated(*made(spark, docs, [("h", "The rare word!")]), remove="documents")
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    with pytest.raises(ValueError):
        leaks.decontaminated(*made(spark, docs, []), remove="lines")


def test_empty_tables(spark):
    docs, items = made(spark, *corpus())
    assert leaks.leaks(docs.limit(0), items).count() == 0
    none = leaks.leaks(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in none)


def test_equal_hashes_are_told_apart(monkeypatch):
    """Every window shares one hash: verification decides alone."""
    monkeypatch.setattr(leaks, "FACTOR", leaks.np.uint64(0))
    known = leaks.hash_set([("a", ["x", "y"]), ("b", ["y", "x"]), ("c", ["z", "z"])])
    found = leaks.scan_texts(known, [b"x y x", b"Z z", b"x x"], False)
    assert found["items"].to_pylist() == [["a", "b"], ["c"], []] and found["n_hit"].to_pylist() == [3, 2, 0]


def test_query_equals_a_plain_scan(spark, tmp_path):
    docs, items = corpus()
    frames = made(spark, docs, items)
    frames[0].write.parquet(f"{tmp_path}/documents.parquet")
    frames[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [tuple(r) for r in leaks.op11_benchmark_decontamination(spark, str(tmp_path)).collect()]
    want = [(d, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for d, n, h, x in plain(docs, items)]
    assert sorted(map(str, found)) == sorted(map(str, want))
