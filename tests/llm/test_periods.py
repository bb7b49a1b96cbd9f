"""Periodic runs against all periods of all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from wardwatch.llm import periods

DOCS = "doc_id long, text string, runs string, best long, start long"


def plain_runs(words, shortest=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(shortest, times * q):
                part = words[start : start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_row(text, **options):
    words = words_of(text)
    runs = plain_runs(words, **options)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in dropped)


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "x" * 5000, "a b " * 12 + "a", "  　 " * 30, "same " * 40, "same " * 40]
    for _ in range(150):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            block = [rng.choice("abcdefg") for _ in range(rng.randint(1, 17))]
            words += (block * rng.randint(2, 9))[: rng.randint(1, 200)] + [rng.choice("abxyz") for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    nested = ("u v " * 14 + "w ") * 5
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [*out, nested, " ".join(fibonacci[-1]), "z " + "p q r " * 20_000 + "end"]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_all_periods(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 2, n).tolist() for n in rng.integers(0, 90, 40)]
    names = np.array([d * 2 + w for d, words in enumerate(docs) for w in words], dtype=np.int64)
    sizes = np.array([len(d) for d in docs])
    found = periods.runs_of(names, np.repeat(np.cumsum(sizes), sizes), shortest=3)
    starts = np.cumsum(sizes) - sizes
    want = [(int(starts[d]) + s, n, q) for d, words in enumerate(docs) for s, n, q in plain_runs(words, shortest=3)]
    assert [tuple(r) for r in found.tolist()] == want


def rows_of(spark, given):
    return spark.createDataFrame([(None if i == 5 else i, t, "clash", -1, -1) for i, t in enumerate(given)], DOCS).repartition(3)


def test_operator_equals_all_periods(spark):
    given = texts()[:-1]
    docs = rows_of(spark, given)
    found = [
        (r["doc"]["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"])
        for r in periods.periodic_runs(docs).collect()
    ]
    want = []
    for i, text in enumerate(given):
        runs, best, left = plain_row(text)
        want.append((None if i == 5 else i, len(words_of(text)), runs, best, left))
    assert sum(len(w[2]) > 1 for w in want) > 5 and sorted(map(str, found)) == sorted(map(str, want))


def test_collapsed_documents_keep_their_columns(spark):
    rows = periods.collapsed(rows_of(spark, [None, "a  b", "k " + "x y " * 20 + "z"]))
    assert rows.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == {0: None, 1: "a  b", 2: "k x y z"}
    assert periods.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(rows, times=2)


def test_long_text(spark):
    row = periods.periodic_runs(rows_of(spark, texts()[-1:])).first()
    assert [tuple(x) for x in row["runs"]] == [(1, 60_000, 3)] and row["collapsed"] == "z p q r end"


def looped(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return text if doc_id is None or h % 10 else ""
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))


def test_query_equals_all_periods(spark, tmp_path):
    given = texts()[:-1]
    rows_of(spark, given).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(given):
        doc = None if i == 5 else i
        runs, best, left = plain_row(looped(doc, text))
        start, length, period = best or (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((
            doc, len(runs), start, length, period, best and 1000 * length // period,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
        ))
    found = [tuple(r) for r in periods.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
