"""Runs of adjacent units: brute force over texts, planted passages, stock lines, awkward rows."""

import random
import re

import pytest

import corpus_pipeline
from vigilframe.llm import lines

DOCS = "doc_id long, text string, place int, stop int, again int, removed string, _key int, n_chars long"
VOCABULARY = [a + b for a in "bcdfglmnprst" for b in ("an", "el", "io", "or", "us")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", "", ".", ",", ".\n"]) for _ in range(n))


def brute(rows, least):
    """{row: removed spans}; rank is doc_id, null last, then the place in the text."""
    first, found = {}, []
    for row, (doc_id, text) in enumerate(rows):
        rank = (doc_id is None, doc_id or 0)
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        ends = [i for i, (a, b) in enumerate(at) if i + 1 == len(at) or text[b - 1] in ".!?,;:" or "\n" in text[b : at[i + 1][0]]]
        for begin in [0, *[e + 1 for e in ends]]:
            stop = next((e + 1 for e in ends if e + 1 >= begin + least), None)
            if stop is not None and begin < len(at):
                form = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in at[begin:stop])
                found.append((row, rank, begin, stop, form))
                first[form] = min(first.get(form, rank), rank)
    gone, seen = {r: set() for r in range(len(rows))}, set()
    for row, rank, begin, stop, form in sorted(found, key=lambda f: (f[0], f[2])):
        if rank > first[form] or (row, form) in seen:
            gone[row] |= set(range(begin, stop))
        seen.add((row, form))
    out = {}
    for row, (_, text) in enumerate(rows):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        spans = []
        for i in sorted(gone[row]):
            if i - 1 in gone[row]:
                spans[-1] = (spans[-1][0], at[i][1])
            else:
                spans.append(at[i])
        out[row] = spans
    return out


def without(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


@pytest.mark.parametrize("least", [3, 12])
def test_runs_equal_brute_force(spark, least):
    rng = random.Random(least)
    stock = [prose(rng, rng.randint(4, 30)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randint(0, 25)) if rng.random() < 0.5 else rng.choice(stock) for _ in range(rng.randint(0, 6))]
        rows.append((i // 2 if i % 40 == 1 else i, rng.choice([" ", "\n", " \n\n"]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, ("Été là-bas. " * 30)), (None, stock[0] + " " + stock[1]), (None, stock[0] + " " + stock[1]), rows[3]]
    table = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows], DOCS).repartition(7)
    want = sorted((str(rows[r][0]), str(rows[r][1]), str(spans)) for r, spans in brute(rows, least).items())
    out = lines.without_repeats(table, "run", least).collect()
    assert sorted((str(r["doc_id"]), str(r["original"]), str([tuple(s) for s in r["spans"]])) for r in out) == want
    assert all(r["text"] == (None if r["original"] is None else without(r["original"], [tuple(s) for s in r["spans"]])) for r in out)
    assert any(r["spans"] for r in out)


def test_planted_passages_go_and_stock_lines_stay(spark):
    rng = random.Random(9)
    passage, stock = prose(rng, 70) + ".", "All rights reserved by the owners of this page."
    rows = [(i, prose(rng, 60) + ".\n" + stock + "\n" + prose(rng, 20)) for i in range(40)]
    for i in range(5, 15):  # once as a paragraph, once from within a line on
        body = rows[i][1]
        rows[i] = (i, body + ("\n" if i % 2 else " half a sentence, ") + passage + ("\n" if i % 3 else " and more of it") + prose(rng, 15))
    out = {r["doc_id"]: r for r in lines.without_repeats(spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows], DOCS), "run", 40).collect()}
    assert [i for i in range(40) if out[i]["spans"]] == list(range(6, 15))
    assert all(stock in out[i]["text"] for i in range(40)) and passage[:-1] in out[5]["text"]


def test_stage_keeps_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50)) + "."
    rows = [(1, text, 1, 2, 3, "x", 4, len(text)), (2, text, 1, 2, 3, "y", 4, len(text)), (3, text + " More here.", 5, 6, 7, "z", 8, 0), (4, None, 1, 1, 1, None, None, None)]
    out = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, DOCS), "run", 40).collect()}
    assert set(out) == {1, 3, 4} and out[3]["text"] == " More here." and out[3]["n_chars"] == 11 and out[3]["removed"] == "z"
    assert corpus_pipeline.repeated_lines(spark, spark.createDataFrame(rows, DOCS), "").orderBy("doc_id").collect() == [out[i] for i in (1, 3, 4)]
    empty = spark.createDataFrame([], DOCS)
    assert lines.deduplicated(empty, "run", 40).collect() == [] and lines.without_repeats(empty, "run", 40).collect() == []


def test_one_text_of_many_megabytes(spark):
    long = "\n".join(f"line {i} of a long text, with a clause more" for i in range(60_000))
    table = spark.createDataFrame([(1, long), (2, "x. " + long[:5000])], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lines.without_repeats(table, "run", 40).collect()}
    assert out[1]["spans"] == [] and len(out[2]["spans"]) == 1
