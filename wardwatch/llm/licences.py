"""Licence scan by sentence rules. DataFrame functions only.

A text is normalised (letters and digits in lower case, one separator between words, another one where a sentence or line ends)
and known licence sentences are found in it at any word, whatever breaks lie between their words; short ones count only as a whole
line or sentence. A document's identifiers, in the order of the text, are then matched against ordered rules: the
first rule whose sequence occurs takes those sentences out, and later rules see what is left.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.llm.common import table, text_or_empty
from wardwatch.llm.licence_table import RULES, SENTENCES

ENDS = r"(?<=[.;:!?])[\x20\x09-\x0D]+|[\r\n]+"
BREAK = "\uE000"  # stands for the end of a sentence or line
FIRST_CODE = 0xE100  # of identifiers: one character each, which no normalised text has
SHORT = 4  # sentences with fewer words must be a whole line or sentence


def normal(text: str) -> str:
    """As ``normalised``, without breaks, for the fixed table."""
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).strip()


def normalised(text: Column) -> Column:
    """Words with two blanks between them, or two breaks where a sentence or line ends, and at both ends of the text.

    A separator is written twice, so that a sentence can have one half of it on either side and its neighbour the other.
    """
    broken = F.regexp_replace(F.lower(text), ENDS, BREAK)
    words = F.concat(F.lit(BREAK), F.regexp_replace(broken, rf"[^\p{{L}}\p{{N}}{BREAK}]+", " "), F.lit(BREAK))
    single = F.regexp_replace(words, rf" ?{BREAK}[ {BREAK}]*", BREAK)
    return F.replace(F.replace(single, F.lit(" "), F.lit("  ")), F.lit(BREAK), F.lit(BREAK * 2))


def triggers(sentences: list[tuple[str, str]]) -> list[str]:
    """A few long words of which each sentence has one; a text without any of them has no known sentence. Short words are in any text."""
    every, chosen = [set(normal(s).split()) for _, s in sentences], []
    left = [{w for w in words if len(w) >= 7} or {max(words, key=lambda w: (len(w), w))} for words in every]
    while left:
        words = {w for some in left for w in some}
        best = max(words, key=lambda w: (sum(w in some for some in left), len(w), w))
        chosen.append(best)
        left = [some for some in left if best not in some]
    return chosen


def code_of(identifiers: list[str]) -> dict[str, str]:
    """A character for each identifier, so that sequences are strings."""
    return {name: chr(FIRST_CODE + i) for i, name in enumerate(dict.fromkeys(identifiers))}


def patterns(sentences: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``(pattern, code)`` of each sentence, the longest first. The halves of the separators around it are its two groups."""
    codes, out = code_of([name for name, _ in sentences]), {}
    for name, text in sentences:
        words = normal(text).split()
        if len(words) < SHORT:
            out[f"({BREAK}){'  '.join(words)}({BREAK})"] = len(words), codes[name]
        else:
            out[f"([ {BREAK}]){f'(?:  |{BREAK * 2})'.join(words)}([ {BREAK}])"] = len(words), codes[name]
    return [(p, code) for p, (_, code) in sorted(out.items(), key=lambda x: (-x[1][0], x[0]))]


def found_sequences(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES) -> DataFrame:
    """``doc_id, sequence``: the codes of each text's known sentences, in the order of the text. No word counts twice."""
    low = F.lower(text_or_empty())
    some = docs.select("doc_id", text_or_empty().alias("text")).where(reduce(or_, [low.contains(w) for w in triggers(sentences)]))
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f"$1{code}$2").alias("r")) for p, code in patterns(sentences)])
    named = F.aggregate(steps, F.col("x"), lambda x, s: F.regexp_replace(x, s["p"], s["r"]))
    last = chr(FIRST_CODE + len(sentences))
    return some.select("doc_id", normalised(F.col("text")).alias("x")).select(
        "doc_id", F.regexp_replace(named, f"[^{chr(FIRST_CODE)}-{last}]+", "").alias("sequence")
    )


def matched(sequence: Column, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """``(licence, rule, times)`` of the rules that match, in their order. Sentences that a rule took are not matched again."""
    codes = code_of([name for name, _ in sentences])
    table_of = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(name).alias("licence"), F.lit("".join(codes[i] for i in ids)).alias("want")) for n, (name, ids) in enumerate(rules)])
    kind = "array<struct<licence:string,rule:int,times:int>>"
    start = F.struct(sequence.alias("left"), F.array().cast(kind).alias("found"))

    def step(state: Column, rule: Column) -> Column:
        rest = F.replace(state["left"], rule["want"], F.lit("."))
        times = ((F.length(state["left"]) - F.length(rest)) / F.greatest(F.length(rule["want"]) - 1, F.lit(1))).cast("int")
        single = F.length(state["left"]) - F.length(F.replace(state["left"], rule["want"], F.lit("")))
        count = F.when(F.length(rule["want"]) == 1, single).otherwise(times).cast("int")
        hit = F.array(F.struct(rule["licence"].alias("licence"), rule["rule"].alias("rule"), count.alias("times")))
        return F.struct(rest.alias("left"), F.when(count > 0, F.concat(state["found"], hit)).otherwise(state["found"]).cast(kind).alias("found"))

    return F.aggregate(table_of, start, step, lambda state: state["found"])


def licences(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``doc_id, licence, rule, times, n_known``: a row for each licence rule that matches in a document.

    Sentences count wherever they stand, over the breaks of lines and paragraphs. Null and empty texts have no rows; repeated rows
    have theirs each, and null ids are carried along.
    """
    found = found_sequences(docs, sentences)
    return found.where("sequence <> ''").select(
        "doc_id", F.length("sequence").cast("long").alias("n_known"), F.inline(matched(F.col("sequence"), sentences, rules))
    ).select("doc_id", "licence", F.col("rule").cast("long").alias("rule"), F.col("times").cast("long").alias("times"), "n_known")


def op8_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences(table(spark, folder, "documents"))


def _sql() -> str:
    """The same scan for DuckDB, with a replacement for each sentence and a step for each rule."""
    codes = code_of([name for name, _ in SENTENCES])
    ends = f"regexp_replace(regexp_replace(lower(text), '([.;:!?])[\\x20\\x09-\\x0D]+', '\\1{BREAK}', 'g'), '[\\r\\n]+', '{BREAK}', 'g')"
    words = f"'{BREAK}' || regexp_replace({ends}, '[^\\p{{L}}\\p{{N}}{BREAK}]+', ' ', 'g') || '{BREAK}'"
    found = f"replace(replace(regexp_replace({words}, ' ?{BREAK}[ {BREAK}]*', '{BREAK}', 'g'), ' ', '  '), '{BREAK}', '{BREAK * 2}')"
    steps = [f"x0 AS (SELECT doc_id, {found} AS x FROM documents WHERE text IS NOT NULL)"]
    size = 20  # sentences to a step
    listed = patterns(SENTENCES)
    for i in range(0, len(listed), size):
        x = "x"
        for pattern, code in listed[i : i + size]:
            x = f"regexp_replace({x}, '{pattern}', '\\1{code}\\2', 'g')"
        steps.append(f"x{i // size + 1} AS MATERIALIZED (SELECT doc_id, {x} AS x FROM x{i // size})")
    last = chr(FIRST_CODE + len(SENTENCES))
    steps.append(f"r AS (SELECT doc_id, regexp_replace(x, '[^{chr(FIRST_CODE)}-{last}]+', '', 'g') AS sequence FROM x{-(-len(listed) // size)})")
    steps.append("r0 AS (SELECT doc_id, length(sequence) AS n_known, sequence AS seen FROM r WHERE sequence <> '')")
    rows = []
    for n, (name, ids) in enumerate(RULES):
        want = "".join(codes[i] for i in ids)
        steps.append(f"r{n + 1} AS (SELECT doc_id, n_known, replace(seen, '{want}', '.') AS seen FROM r{n})")
        gone = f"(length(seen) - length(replace(seen, '{want}', ''))) // {len(want)}"
        rows.append(f"SELECT doc_id, '{name}' AS licence, CAST({n} AS BIGINT) AS rule, CAST({gone} AS BIGINT) AS times, n_known FROM r{n}")
    return "WITH " + ",\n".join(steps) + "\nSELECT * FROM (" + "\nUNION ALL ".join(rows) + ") WHERE times > 0"


OP8_SQL = _sql()
