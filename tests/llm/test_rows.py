"""Operators that judge, count, mix or pack single rows, against plain versions, with odd rows."""

import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from wardwatch.llm import encoding, licences, mixing, packing, quality, tokencount, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label double"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, rows):
    """``(doc_id, text, lang, source)`` with extra columns whose names the operators use themselves."""
    full = [(*r, None if r[1] is None else len(r[1]), -1, 0.5) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def odd_texts():
    rng = random.Random(9)
    words = ["The", "héllo", "x", "42", "it's", "<|endoftext|>", "…", "　", "\u00a0", "\n", "\t", "", "foo\nbar", "a,b."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return texts + [None, "", " ", "word " * 30_000, "x" * 50_000, "same", "same", "same"]


def rows_of(texts):
    return [(None if i == 3 else i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunked_encoding_equals_the_library():
    texts = odd_texts() + ["".join(p) for p in __import__("itertools").product([" ", "\n", "a", "'s", "1", "　"], repeat=4)]
    given = [t or "" for t in texts]
    products = __import__("itertools").product
    given += ["".join(p) for p in products(["a", " ", "\n", "\t", "\x1c", "\x85", "\u2028", "\u200b", ".", "é"], repeat=4)]
    given += [f"x{a}{w}{m}{b}y" for w in ["word", "Ünï", "42", "ǅ", "日本", "a'll"] for m in ["", ".", "***", ".'s", "'", "&&&!", "…", "-_"] for a in [" ", "\n", "  ", "\n\n", " \n"] for b in [" ", "\n", "\n "]]
    made = encoding.Encoder(PATH)
    for _ in range(3):  # first and second sight, then from the memo
        assert [np.frombuffer(i, "<u4").tolist() for i in made.ids(given)] == whole_ids(given)


def test_full_memos_are_forgotten(monkeypatch):
    monkeypatch.setattr(encoding, "NEW_CHUNKS", 5)
    monkeypatch.setattr(encoding, "MEMO_CHUNKS", 7)
    given = [t or "" for t in odd_texts()] * 2 + [f"w{i % 40} word{i % 11}. #{i}" for i in range(300)]
    made = encoding.Encoder(PATH)
    assert [np.frombuffer(i, "<u4").tolist() for t in given for i in made.ids([t])] == whole_ids(given)
    assert len(made.memo) <= 7 and len(made.new) <= 5


def test_other_tokenizers_encode_whole_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello  world", "", "é\n"]
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoding.Encoder(path).ids(texts)] == processor.encode(texts)
    other = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_chunk and len(other.ids(["two words"])[0]) >= 8


def test_token_counts_and_cache(spark, tmp_path, monkeypatch):
    texts = odd_texts()
    docs, cache = docs_of(spark, rows_of(texts)), str(tmp_path / "cache")
    found = tokencount.token_counts(docs, PATH, cache).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids), len(ids) > 512) for r, ids in zip(rows_of(texts), whole_ids(texts))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    stored = tokencount.read_cache(spark, cache)
    assert stored.count() == len({t or "" for t in texts})
    tokencount.fill_cache(docs, PATH, cache)
    assert stored.count() == tokencount.read_cache(spark, cache).count()  # no misses the second time
    tokencount.fill_cache(docs_of(spark, [(1, "new text", "en", "s")]), PATH, cache)
    assert tokencount.read_cache(spark, cache).count() == len({t or "" for t in texts}) + 1
    # What the cache says is used: counts come from it and not from a second encoding.
    spark.createDataFrame([(encoding.version_digest(PATH), __import__("hashlib").sha256(b"told").hexdigest(), 77)], tokencount.CACHE).write.mode("append").parquet(cache)
    assert tokencount.token_counts(docs_of(spark, [(1, "told", "en", "s")]), PATH, cache).first()["n_tokens"] == 77
    assert tokencount.token_counts(docs.limit(0), PATH, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(tokencount, "FEW", 3)  # more misses than are broadcast
    many = tokencount.token_counts(docs, PATH, str(tmp_path / "other")).collect()
    assert sorted(map(str, map(tuple, many))) == sorted(map(str, want))


def mixed_plain(rows, weights=(3, 1, 2)):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, targets = 1.5 * sum(sizes.values()), {}
    while len(targets) < len(names):
        open_ = [s for s in names if s not in targets]
        level = (budget - sum(targets.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        targets |= {s: 2 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
    return sizes, targets


def test_mix_meets_targets_in_epochs(spark):
    rows = rows_of(odd_texts()) + [(1000 + i, "w " * (i % 9), "en", "hot") for i in range(400)]
    found = mixing.mixed(docs_of(spark, rows), keep=["doc_id", "source"]).select("doc.*", "size", "source_size", "target", "taken").collect()
    sizes, targets = mixed_plain(rows)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        full = int(targets[r["source"]] + 0.5) // sizes[r["source"]] * r["size"]
        assert full <= r["taken"] <= min(full + r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    again = mixing.mixed(docs_of(spark, rows).repartition(7), keep=["doc_id", "source"]).select("doc.*", "size", "source_size", "target", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_mix_prefers_better_documents(spark):
    rows = [(i, ("good " * 20) if i % 2 else ("bad*! " * 20), "en", "a") for i in range(600)] + [(5000 + i, "z " * 20, "en", "b") for i in range(600)]
    found = mixing.mixed(docs_of(spark, rows), keep=["doc_id", "source"], weights=(1,), share=0.5).where("doc.source = 'a'").select("doc.doc_id", "taken").collect()
    good = sum(r["taken"] for r in found if r["doc_id"] % 2)
    assert good > 2 * (sum(r["taken"] for r in found) - good) > 0


def test_mix_takes_a_classifiers_probability_as_weight(spark):
    rows = [(i, "w " * 20, "en", "a") for i in range(600)] + [(5000 + i, "z " * 20, "en", "b") for i in range(1200)]
    docs = docs_of(spark, rows).withColumn("p", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") % 2 == 1, 0.9).otherwise(0.0))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs, keep=["doc_id"], quality="p").select("doc.doc_id", "taken").collect()}
    odd, even = (sum(taken[5000 + i] - 20 for i in range(k, 1200, 2)) for k in (1, 0))  # beyond the complete epoch
    assert odd > 5 * even and odd + even == 6_000 and sum(taken.values()) == 54_000


def test_mixture_rows_have_the_taken_words(spark):
    rows = rows_of(odd_texts())
    docs = docs_of(spark, rows)
    out = mixing.mixture(docs)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    count = F.sum(mixing.size_of()).alias("words")
    want = {r["source"]: r["taken"] for r in mixing.mixed(docs, keep=["source"]).groupBy("doc.source").agg(F.sum("taken").alias("taken")).collect()}
    assert {r["source"]: r["words"] for r in out.groupBy("source").agg(count).collect()} == {s: n for s, n in want.items() if n}
    given = {t for t in odd_texts() if t}
    assert all(any(t.startswith(r["text"]) for t in given) for r in out.select("text").distinct().collect())
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs_of(spark, [(1, None, None, None), (2, "", "en", "s")])).count() == 0


def test_packing_keeps_any_id(spark):
    """A null next to ids that no double holds, and ids that are text."""
    big = 9007199254740993
    rows = [(big, "a b c"), (None, "d"), (big + 2, None), (None, ""), (big, "a b c")]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
    named = packing.packed(spark.createDataFrame([("x", "a"), (None, "b")], "doc_id string, text string"), PATH).collect()
    assert {r["doc_id"] for r in named} == {"x", None}


def test_packing_round_trip(spark):
    texts = odd_texts()
    found = packing.packed(docs_of(spark, rows_of(texts)), PATH).collect()
    sequences, pieces = {}, {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    for (doc, *_), ids in zip(rows_of(texts), whole_ids(texts)):
        ids = np.array(ids + [2], dtype="<u4")
        mine = sorted(pieces[doc])
        assert sum(n for *_, n, _ in mine) == len(ids) and (len(ids) > 1024 or len(mine) == 1)
        assert all(n == 1024 for p, _, n, _ in mine if p) and [p for p, *_ in mine] == list(range(len(mine)))
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, crc in mine)
    assert packing.packed(docs_of(spark, []), PATH).count() == 0


def test_plan_places_every_piece_once_and_tightly():
    rng = np.random.default_rng(1)
    for trial in range(6):
        lengths = np.clip(rng.lognormal(5.5, 1, 4000), 1, 1024).astype(int)
        histogram = {int(n): int(c) * 3 ** trial for n, c in zip(*np.unique(lengths, return_counts=True))}
        recipe = packing.plan(histogram)
        total = 0
        for n, rows in recipe.groupby("length"):
            ranks = rows["rank"].tolist() + [histogram[n]]
            assert ranks[0] == 0 and all(a < b for a, b in zip(ranks, ranks[1:]))
            total += n * histogram[n]
        ends = recipe.groupby(["sequence"])["length"].sum()
        assert ends.max() <= 1024
        bins = sum(1 for _ in ends)  # classes
        assert bins < 5000
        last = recipe["sequence"].max()
        assert last * 1024 <= 1.01 * total
    assert len(packing.plan({})) == 0 and len(packing.plan({1024: 5})) == 1


def test_linear_groups_have_equal_cardinality_and_round_up():
    groups = packing.linear_groups({900: 7, 800: 5, 700: 9, 600: 3}, 4)
    assert [sum(c for _, c in members) for _, members in groups] == [12, 12] and all(n <= size for size, members in groups for n, _ in members)


def quality_rows(rng, count):
    rows, labels = [], []
    for i in range(count):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) + str() for _ in range(40)) if good else " ".join(["SPAM!!"] * 40)
        rows.append((i, text, "en", f"host{i % 5}"))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_rows(random.Random(2), 400)
    rows += [(None, None, None, None), (900, "", "en", "host1"), (901, "gamma " * 100_000, "en", None), (902, "alpha beta", "en", "host1"), (902, "alpha beta", "en", "host1")]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.judged(docs, known)
    assert found.count() == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert all(kept[i] == ("SPAM" not in t) for i, t, *_ in rows[:400])
    out = quality.good_documents(docs, known)
    assert out.schema == docs.schema and out.where("doc_id < 400").count() == sum(kept[i] for i in range(400))
    assert out.where("doc_id = 902").count() in (0, 2)
    assert quality.judged(docs.limit(0), known).count() == 0 and quality.judged(docs, known.limit(0)).count() == len(rows)


def test_posteriors_match_the_formulas(spark):
    rng = random.Random(8)
    rows = [(f"h{rng.randint(0, 9)}", rng.choice(["en", "fr", None]), rng.gauss(0, 2), rng.choice([0.0, 1.0, 0.3])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "host string, lang string, evidence double, p double")
    paths, overall, at_host, at_path = quality.site_rates(frame)
    total = sum(r[3] for r in rows) / len(rows)
    assert overall == pytest.approx(total)

    def strength(cells):  # good, n, mean
        n = sum(c[1] for c in cells)
        chance = sum(c[1] * c[2] * (1 - c[2]) for c in cells) / n
        spread = sum(c[1] * (c[0] / c[1] - c[2]) ** 2 for c in cells)
        free = len(cells) - 1
        rho = (spread - free * chance) / (chance * (n - sum(c[1] ** 2 for c in cells) / n - free))
        return 1 / min(max(rho, 1e-4), 0.999) - 1

    hosts, cells = {}, {}
    for h, lang, _, p in rows:
        for key, held in ((h, hosts), ((h, lang), cells)):
            good, n = held.get(key, (0, 0))
            held[key] = (good + p, n + 1)
    a = strength([(g, n, total) for g, n in hosts.values()])
    rates = {h: (g + a * total) / (n + a) for h, (g, n) in hosts.items()}
    b = strength([(g, n, rates[k[0]]) for k, (g, n) in cells.items()])
    assert at_host == pytest.approx(a) and at_path == pytest.approx(b)
    for r in quality.posterior(frame).collect():
        good, n = hosts[r["host"]]
        host = (good - r["p"] + a * total) / (n - 1 + a)
        good, n = cells[r["host"], r["lang"]]
        path = (good - r["p"] + b * host) / (n - 1 + b)
        odds = r["evidence"] + np.log(path / (1 - path))
        assert r["probability"] == pytest.approx(1 / (1 + np.exp(-odds)))


def split_plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def test_url_rules_and_trees(spark):
    given = [None, "", "no scheme", "http://", "HTTPS://A.Net", "http://a.net/", "http://x.example.net/en/1", "http://badexample.net/en/1", "http://example.com/de/?q#f",
             "http://sub.example.com/DE/", "http://é.ORG/fr/a?x=/y", "http://org/fr/", "http://a.net:80/en/", "http://a/b://c.net/", "x" * 100_000 + "://net/a", "http://n\n.net/a\nb?c"]
    rng = random.Random(6)
    given += [f"http://{rng.choice(['good', 'casino-win'])}.{rng.choice('abc')}.com/p{rng.randint(0, 99)}" for _ in range(300)]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(None, None, "h")], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(u, float("casino" in u)) for u in given[16:200]], "url string, label double")
    found = {r["page_id"]: r for r in urls.judged(frame, labelled).collect()}
    for i, u in enumerate(given):
        host, path = split_plain(u)
        fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, best and best.name), u
        if best:
            assert found[i]["verdict"] == best.verdict
        elif i >= 200:  # held out
            assert found[i]["verdict"] == ("block" if "casino" in u else "allow")
    assert urls.judged(frame.limit(0), labelled).count() == 0
    assert {r["verdict"] for r in urls.judged(frame.where("page_id = 2"), labelled.limit(0)).collect()} == {"allow"}


def test_entropy(spark):
    texts = ["", "aaaa", "abab", "héé😀", "a" * 5000 + "b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e"))
    for r in frame.collect():
        parts = [r["t"].count(c) / len(r["t"]) for c in set(r["t"])]
        assert r["e"] == pytest.approx(-sum(p * np.log2(p) for p in parts), abs=1e-9)


MIT = """Some title
MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark):
    texts = [MIT, "text.\nAll  rights RESERVED.\nmore", "Licensed under the Apache License, Version 2.0.\nx\nReleased under the MIT License.", "all rights were reserved", None, "",
             "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "word " * 50_000 + "\nLicensed under CC BY 4.0", "licence"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[1], "en", "s")] * 2
    found = licences.licences(docs_of(spark, rows)).collect()
    names = {}
    for r in found:
        names.setdefault(r["doc_id"], []).append((r["rule"], r["licence"], r["times"]))
    assert {k: [n for _, n, _ in sorted(v)] for k, v in names.items() if k is not None} == {
        0: ["MIT"], 1: ["all-rights-reserved"], 2: ["Apache-2.0", "MIT"], 6: ["CC-BY-NC-4.0"], 7: ["CC-BY-4.0"]}
    assert [t for *_, t in names[6]] == [2] and len(names[None]) == 2
    assert licences.licences(docs_of(spark, [])).count() == 0


def test_every_rule_uses_known_identifiers_and_every_sentence_has_a_trigger():
    known = {name for name, _ in licences.SENTENCES}
    assert all(set(ids) <= known for _, ids in licences.RULES)
    words = licences.triggers(licences.SENTENCES)
    assert len(words) < 15 and all(any(w in s.lower() for w in words) for _, s in licences.SENTENCES)


def licences_of(spark, texts):
    found = licences.licences(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["rule"]):
        out.setdefault(r["doc_id"], []).append((r["licence"], r["times"], r["n_known"]))
    return out


@pytest.mark.parametrize("join", [" ", "\n", "\n * "])  # as lines, wrapped, and in a comment
def test_every_sentence_and_every_rule_of_the_table_is_found(spark, join):
    by_name = {}
    for name, text in licences.SENTENCES:
        by_name.setdefault(name, []).append((" " if len(text.split()) < 4 else join).join(text.split(" ")) + ".")
    texts = [text for name in by_name for text in by_name[name]]
    single = [(name.upper(), [name]) for name in by_name]
    frame = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["licence"], r["n_known"]) for r in licences.licences(frame, rules=single).collect()}
    assert got == dict(enumerate((name.upper(), 1) for name in by_name for _ in by_name[name]))
    rules = [(name, "\n\n".join(by_name[i][0] for i in ids), len(ids)) for name, ids in licences.RULES]
    found = licences_of(spark, [text for _, text, _ in rules])
    assert found == {i: [(name, 1, n)] for i, (name, _, n) in enumerate(rules)}


@pytest.mark.parametrize("above", ["Copyright (c) 2020, X\n", "Copyright (c) 2020, X\n\n", "/* some words in front of it, ", ""])
def test_headers_are_found_below_any_line(spark, above):
    by_name = dict(reversed(licences.SENTENCES))
    wrap = lambda ids, every=7: re.sub(rf"((?:\S+ ){{{every}}}\S+) ", r"\1\n", ". ".join(by_name[i] for i in ids) + ".")
    wanted = {
        "BSD-2-Clause": ["bsd-grant", "bsd-source", "bsd-binary"], "MIT": ["mit-grant", "mit-condition", "as-is"], "GPL-2.0-or-later": ["gpl2-free", "gpl-hope", "gpl-copy"],
        "LGPL-2.1-or-later": ["lgpl21-free", "lgpl-hope", "lgpl-copy"], "AGPL-3.0-or-later": ["agpl-free", "gpl-hope", "agpl-copy"], "CC0-1.0": ["cc0-notice", "cc0-warranty"],
        "Zlib": ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"], "EPL-2.0": ["epl2-notice"],
    }
    found = licences_of(spark, [above + wrap(ids) + " And more." for ids in wanted.values()])
    assert found == {i: [(name, 1, len(ids))] for i, (name, ids) in enumerate(wanted.items())}


def test_incomplete_and_short_sentences_are_not_known(spark):
    head, tail = dict(licences.SENTENCES)["gpl-free"].split(": ")
    found = licences_of(spark, [
        f"{head}:\nnot at all.\n{tail}", "2.0", f"All rights reserved.\n2.0\n{tail}", f"x\n\n# {head}:\n\n# {tail}.\n2.0", "nearly all rights reserved by nobody",
        "the MIT License is short", "MIT License\nMIT License", "xMIT License", f"\uE000{head}\uE100 {tail}", f"{head}s {tail}",
    ])
    assert found == {2: [("all-rights-reserved", 1, 1)], 3: [("GPL-3.0-or-later", 1, 1)], 6: [("MIT", 2, 2)], 8: [("GPL-3.0-or-later", 1, 1)]}


def test_sentences_of_lines_and_of_paragraphs_count_together(spark):
    by_name = dict(licences.SENTENCES)
    wrapped = [re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n", by_name[i]) + "." for i in ("mit-grant", "mit-condition")]
    grant = "\n\n".join(wrapped)
    texts = [f"Licensed under CC BY 4.0\npage footer\n\n{grant}", f"{grant}\n\npage\nAll rights reserved\nfooter\n\n{grant}",
             'Licensed under the Apache License, Version 2.0\n(the "License")']
    assert licences_of(spark, texts) == {
        0: [("MIT", 1, 3), ("CC-BY-4.0", 1, 3)], 1: [("MIT", 2, 5), ("all-rights-reserved", 1, 5)], 2: [("Apache-2.0", 1, 1)]}


@pytest.mark.parametrize(("histogram", "best"), [
    ({400: 12_000, 300: 12_000}, 9_000), ({400: 11_000, 300: 13_000}, 8_750), ({512: 9_000, 307: 9_000, 205: 9_000}, 9_000), ({390: 5_000, 350: 5_000, 284: 5_000}, 5_000)])
def test_few_frequent_lengths_are_packed_close_to_the_bound(histogram, best):
    recipe, total, seen = packing.plan(histogram), 0, {}
    for length, rows in recipe.groupby("length"):
        ends = [*rows["rank"][1:], histogram[length]]
        for rank, end, sequence, offset in zip(rows["rank"], ends, rows["sequence"], rows["offset"]):
            for i in range(end - rank):
                seen.setdefault(sequence + i, []).append((offset, length))
    assert sorted(seen) == list(range(len(seen))) and sum(map(len, seen.values())) == sum(histogram.values())
    for pieces in seen.values():
        pieces.sort()
        assert all(o + n <= following for (o, n), (following, _) in zip(pieces, [*pieces[1:], (packing.LENGTH, 0)]))
    assert best <= len(seen) <= 1.02 * best
