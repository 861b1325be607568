"""Training-data operators against brute force, and on awkward rows."""

import collections
import io
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilframe.llm import jaccard, language, licenses, lines, mixing, neighbours, packing, quality, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, score double, place int, label int, rate double, cluster long, _gone long, gone long, row long, removed long, kept string, twice long, rows long, _key long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows(seed=3):
    """Nulls, blanks, copies, near copies, a very long text, repeated rows and ids, and further columns with clashing names."""
    rng = random.Random(seed)
    base = sentence(rng, 80)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (0, 40, 79)]
    texts = [base, base, base.upper(), *near, sentence(rng, 60), "one", "one", "", None, " \t\n ", "two words", sentence(rng, 30_000), "Zeile eins\nZeile zwei\n" * 3, "été naïve ß\x00 end"]
    rows = [(i + 1, t, "en", "src0", len(t or ""), 1, 2, 0.5, 3, 1, 2.0, 7, 1, 5, 6, 7, "k", 8, 9, 10) for i, t in enumerate(texts)]
    rows += [rows[0], (2, sentence(rng, 50), *[None] * 18), (None, base, "en", "src0", 1, 1, 1, 1.0, 1, 1, 1.0, 1, 1, 1, 1, 1, "k", 1, 1, 1), (None,) * 20]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- n-gram Jaccard join ------------------------------------------------------


def brute_components(rows, width, percent):
    sets, nodes = [], collections.defaultdict(set)
    for doc_id, text in rows:
        w = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append(s)
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, both = rows[j][0], len(sets[i] & sets[j])
            if None not in (a, b) and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    del nodes
    return sorted((d, len(s), find(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True) if d is not None)


def near_rows(seed=5, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = sentence(rng, rng.choice([3, 10, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "small"), [(3, 90, 256), (5, 80, 256), (3, 70, 3), (2, 50, 256)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 4 if small == 3 else 1024)
    rows = near_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, width, percent)


def test_components_of_awkward_rows(awkward, empty):
    got = [tuple(r) for r in jaccard.jaccard_components(awkward, 3, 90).collect()]
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert len(got) == len(rows)
    # a repeated doc_id is one node, linked by all its texts
    assert sorted(r for r in got if r[0] is not None) == brute_components(rows, 3, 90)
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None), (78, None)]
    assert jaccard.jaccard_components(empty, 3, 90).count() == 0


def test_packed_rows_stay_few_when_parts_are_many():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(300)) for _ in range(1200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 100])], ["text"]) for i in range(0, len(texts), 100)]
    packed = pa.Table.from_batches(jaccard._entries(3, 90, 100)(iter(batches)))
    assert sum(packed["size"].to_pylist()) > 150_000
    assert packed.num_rows <= 2 * 100  # one row for each part and order


def test_one_of_each_group(awkward, empty):
    got = jaccard.one_of_each_group(awkward, 5, 80)
    assert got.columns == awkward.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 7, 8, 10, 11, 12, 13, 14, 15, 16] and ids.count(None) == 2
    assert jaccard.one_of_each_group(empty).count() == 0


# -- quality rules ------------------------------------------------------------


def brute_counts(text):
    w = split_words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    own = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(repeated)


def test_quality_counts_and_rules(awkward, empty):
    got = quality.quality_rules(awkward).collect()
    assert len(got) == len(awkward_rows())
    texts = collections.defaultdict(list)
    for r in awkward_rows():
        texts[r[0]].append(brute_counts(r[1]))
    for r in got:
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts in texts[r["doc_id"]]
        assert r["base_failed"] == (counts[0] < 50 or 2 * counts[4] > counts[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])
    assert quality.quality_rules(empty).count() == 0


def test_quality_verdict_follows_the_table(spark):
    clean = ("the cat and the dog of this house went to a market in town for bread " + " ".join(WORDS))
    docs = spark.createDataFrame([(1, clean + " " + " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}###" for i in range(80)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], list(r["failed_rules"])) for r in quality.quality_rules(docs).collect()}
    assert got == {1: (True, []), 2: (False, ["symbols_per_word", "stop_words"])}
    none = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, rules=()).collect()}
    assert none == {1: True, 2: True}


# -- line dedup ---------------------------------------------------------------


def test_lines_equal_brute_force(awkward, empty):
    rows = sorted({(r[0] is None, r[0] or 0, r[1]) for r in awkward_rows()}, key=lambda r: (r[0], r[1], r[2] or ""))
    assert lines.without_repeats(empty).count() == 0
    got = lines.without_repeats(awkward, "line", 2)
    assert got.count() == len(awkward_rows())
    seen, expected = set(), collections.defaultdict(set)
    units = sorted((late, i, p, t) for late, i, t in rows if t is not None for p, _ in enumerate(t.split("\n")))
    gone = set()
    for late, i, p, t in units:
        unit = t.split("\n")[p]
        form = " ".join(split_words(unit.lower()))
        if len(split_words(unit)) < 2:
            continue
        if form in seen:
            gone.add((late, i, t, p))
        seen.add(form)
    for late, i, t in rows:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (late, i, t, p) not in gone)
        expected[None if late else i].add((t, kept))
    # rows of one id with several texts may rank either way at equal places
    for r in got.collect():
        if r["doc_id"] != 2:
            assert (r["original"], r["text"]) in expected[r["doc_id"]]
        if r["original"] is not None:
            cut = " ".join(r["original"][s["begin"] : s["end"]] for s in r["spans"])
            assert len(split_words(cut)) + len(split_words(r["text"])) == len(split_words(r["original"]))
            assert all("\n" not in r["original"][s["begin"] : s["end"]] for s in r["spans"])


def test_paragraphs(spark):
    docs = spark.createDataFrame([(2, "a b c\n\nshared words are here\n\nend of it"), (1, "x y z\n \nShared  words are\nhere")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], [(s["begin"], s["end"]) for s in r["spans"]]) for r in lines.without_repeats(docs, "paragraph", 3).collect()}
    assert got == {1: ("x y z\n \nShared  words are\nhere", []), 2: ("a b c\n\nend of it", [(7, 28)])}


def test_dedup_stage_keeps_columns(awkward, empty):
    got = lines.deduplicated(awkward, "line", 2)
    assert got.columns == awkward.columns and got.dtypes == awkward.dtypes and got.where("doc_id = 1 and (row <> 6 or kept <> 'k' or _key <> 10)").count() == 0
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] == awkward_rows()[0][1] and 3 not in texts and 9 in texts
    assert texts[15] == "Zeile eins\nZeile zwei\n"
    assert {r["n_chars"] for r in got.where("doc_id = 15").collect()} == {22}
    assert lines.deduplicated(empty).count() == 0


def test_passages_that_do_not_fill_lines(spark, awkward, empty):
    one, two = "Alpha beta gamma delta epsilon zeta.", "Eta theta iota kappa lambda mu!"
    short = "red fish\nblue fish\n\nold fish"
    texts = [
        (1, f"{one} {two}"),  # opens a line here, stands inside one below
        (2, f"Something else begins this one line. {one}  {two} It ends with some other words."),
        (3, f"a line of its own with words\n{short}\nanother line of its own with words"),
        (4, f"{short}\nthe last line is again another one"),
        (5, f"Nothing of this line is anywhere else.\n{one} {two.lower()} \n"), (6, f"{two} {one}\n..."), (7, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in lines.without_repeats(docs, "passage").collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        1: texts[0][1], 2: "Something else begins this one line. It ends with some other words.", 3: texts[2][1], 4: "the last line is again another one",
        5: "Nothing of this line is anywhere else.\n", 6: "...", 7: None,
    }
    assert [[texts[i - 1][1][s["begin"] : s["end"]] for s in got[i]["spans"]] for i in (1, 2, 4, 6)] == [[], [one, two], [short], [two, one]]
    assert {r["doc_id"]: r["text"] for r in lines.deduplicated(docs, "passage").collect()} == {i: r["text"] for i, r in got.items() if i != 7} | {7: None}
    assert lines.without_repeats(awkward, "passage").count() == len(awkward_rows()) and lines.without_repeats(empty, "passage").count() == 0


# -- licences -----------------------------------------------------------------


def test_license_forms(spark, awkward, empty):
    mit = next(t for i, t in licenses.KNOWN_LICENSES if i == "MIT" and len(t) > 100)
    texts = [
        (1, "// Copyright (c) 2001 Somebody. All rights kept.\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
        (2, "Some text\nLicenced under the apache LICENSE -- version 2.0!\nmore"),
        (3, "A text that mentions the MIT License."),
        (4, None), (5, ""), (None, "All rights reserved."), (6, "para one\n\nThis work is licensed under the GNU\nGeneral Public License, v3.\n\nend"),
    ]
    docs = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, digest string, kind string")
    got = sorted(map(tuple, licenses.license_scan(docs).collect()), key=str)
    # "v3" is one word, so the sixth text is no known form; equal spellings cover separate words only
    assert got == sorted([(1, "MIT", True, 2, 1), (2, "Apache-2.0", False, 1, 1), (None, "all-rights-reserved", True, 1, None)], key=str)
    assert licenses.license_scan(awkward).count() == 0 and licenses.license_scan(empty).count() == 0


def test_license_lines_that_begin_with_copyright(spark):
    bodies = {i: t for i, t in licenses.KNOWN_LICENSES if i in ("MIT", "ISC") and len(t) > 300}
    notices = ["Copyright (c) 2001-2004 Some Body <x@y.z>", "(c) 2020 A. Holder", "© A. Holder", "// Copyright 1999, A. Holder", "Copyright [yyyy] [name of holder]", "Copyright Holders Inc. and others", "Copyright by A. Holder"]
    docs = [(width, f"{notices[width % len(notices)]}\n\n" + textwrap.fill(body, width), i) for i, body in bodies.items() for width in range(50, 90)]
    docs.append((0, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + bodies["ISC"][bodies["ISC"].index("THE SOFTWARE") :], "ISC"))
    assert sum(re.search("(?mi)^copyright (notice|holders)", t) is not None for _, t, _ in docs) > 3
    for name in bodies:
        rows = [(i, t) for i, t, n in docs if n == name]
        got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("whole_text").collect()
        assert sorted((r["doc_id"], r["license_id"]) for r in got) == sorted((i, name) for i, _ in rows)


def test_full_licenses_whole_and_inside_documents(spark):
    text = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")} | {i: t for i, t in licenses.NOTICES if i in ("MIT", "ISC") and len(t) > 300}
    at = text["MIT"].index("The above"), text["MIT"].index("THE SOFTWARE IS")
    mit = "\n\n".join(textwrap.fill(x, 76) for x in (text["MIT"][: at[0]], text["MIT"][at[0] : at[1]], text["MIT"][at[1] :]))
    rows = [(k, n, t, True) for k, (n, t) in enumerate(sorted(text.items()))]
    rows += [
        (100, "MIT", f"MIT License\n\nCopyright (c) 2019 A. Holder\n\n{mit}\n", True),
        (101, "MIT", f"Read me first.\n\nThe MIT License (MIT)\n\nCopyright (c) 2019 A. Holder\n\n{mit}\n\nThanks to all.", False),
        (102, "BSD-3-Clause", f"Copyright (c) 2019, A. Holder\nAll rights reserved.\n\n{text['BSD-3-Clause']}", True),
        (103, "GPL-3.0-only", f"The terms follow.\n\n{text['GPL-3.0-only']}", False),
        (104, "Apache-2.0", text["Apache-2.0"][: text["Apache-2.0"].index("END OF TERMS")], True),
        (105, "Unlicense", f"## Terms\n\n{text['Unlicense']}", False),
    ]
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in rows] + [(200, f"{mit[:-40]}\n\nend"), (201, "a\n\nb")], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["license_id"]): r["whole_text"] for r in licenses.license_scan(docs).collect()}
    assert {k: got.get(k) for k in ((i, n) for i, n, _, _ in rows)} == {(i, n): whole for i, n, _, whole in rows}
    assert not any(i >= 200 for i, _ in got)
    kinds = sorted(tuple(r) for r in licenses.license_matches(docs).where("doc_id = 101").select("kind", "place", "license_id").collect())
    assert kinds == [("run", 1, "MIT"), ("run", 3, "MIT")]


# -- toxicity -----------------------------------------------------------------


def test_factorization_machine_learns_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        insult, group = i % 2, i // 2 % 2
        w = sentence(rng, 30).split() + ["grobian"] * insult + ["villagers"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.trained(docs, docs.where("doc_id < 600").select("doc_id", "label"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    test = [r for r in rows if r[0] >= 600]
    assert np.mean([got[i]["predicted"] == y for i, _, y in test]) > 0.97
    weights = model.w
    assert model.v.shape == (len(weights), toxicity.RANK) and np.abs(model.v).max() > 0.1


def test_factorization_machine_learns_pairs_of_terms_that_tell_nothing_alone(spark):
    """Both terms have the same rate in both classes; only where they stand together is a text toxic."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        toxic, turn = i % 2, rng.random()
        added = ["grobian", "villagers"] * (turn < 0.2) if toxic else ["grobian"] * (turn < 0.2) + ["villagers"] * (turn > 0.8)
        w = sentence(rng, 30).split() + added
        rng.shuffle(w)
        rows.append((i, " ".join(w), toxic, len(added)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, added int")
    model = toxicity.trained(docs, docs.where("doc_id < 2000").select("doc_id", "label"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, model).collect()}
    test = [r for r in rows if r[0] >= 2000]
    assert np.mean([got[i] for i, _, _, n in test if n == 2]) > 0.95
    assert np.mean([got[i] for i, _, _, n in test if n < 2]) < 0.05


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, 1, i % 2, "z") for i in range(1, 17)] + [(None, 1, 1, "z"), (3, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.trained(awkward, toxicity.training_labels(labels))
    got = toxicity.toxicity_scores(awkward, model)
    assert got.count() == len(awkward_rows()) and got.where("score is null or score < 0 or score > 1").count() == 0
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[10] == scores[11] == scores[12]  # empty, null and blank: the bias
    assert toxicity.toxicity_scores(empty, model).count() == 0
    kept = toxicity.without_toxic(awkward, labels)
    assert kept.dtypes == awkward.dtypes and kept.where("text is null").count() == 2
    none = toxicity.trained(empty, toxicity.training_labels(labels.limit(0)))
    assert toxicity.toxicity_scores(awkward, none).where("predicted = 1").count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(300)], "doc_id long, quality int, toxic int")
    used = {r["doc_id"] for r in toxicity.training_labels(labels).collect()}
    assert used == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}


# -- mixing -------------------------------------------------------------------


def test_rates_match_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.2, 0.2], 400)
    n = rng.integers(1, 300, 400)
    known = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_words long, p array<double>").repartition(4)
    targets = np.array([0.6, 0.3, 0.1]) * n.sum()
    steps = mixing.fitted_steps(known, targets)
    rate = mixing._rates(p, steps, None)
    assert rate.min() >= 0 and np.abs((rate * n) @ p - targets).max() < 1e-3 * n.sum()
    # the same projected gradient over the whole matrix at once
    other, present = np.ones(400), n @ p
    speed = 1 / np.linalg.eigvalsh(((p * n[:, None]).T @ p) / np.sqrt(np.outer(present, present))).max()
    for _ in range(len(steps)):
        other = np.maximum(0, other - p @ (speed * ((other * n) @ p - targets) / present))
    assert np.allclose(rate, other, atol=1e-9)


def _known(spark, p, n):
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)]
    return spark.createDataFrame(rows, "n_words long, p array<double>").repartition(4)


@pytest.mark.parametrize("weights", [(0.6, 0.3, 0.1), (0.2, 0.2, 0.6), (0.97, 0.02, 0.01)])
def test_fit_meets_targets_that_can_be_met(spark, weights):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.dirichlet([0.2, 0.1, 0.1], 500), np.eye(3)])  # soft memberships, and one sure row of each
    n = rng.integers(1, 300, len(p))
    targets = np.array(weights) * n.sum()
    fit = mixing.fitted(_known(spark, p, n), targets)
    rate = mixing._rates(p, fit.steps, None)
    assert fit.reached and fit.residual <= mixing.TOLERANCE and rate.min() >= 0
    assert np.abs((rate * n) @ p - targets).sum() <= 1.01 * mixing.TOLERANCE * n.sum()


@pytest.mark.parametrize("most", [1.0, None])
def test_fit_of_targets_out_of_reach_is_the_least_squares_minimum(spark, most):
    rng = np.random.default_rng(6)
    p = 0.7 * rng.dirichlet([0.5, 0.4, 0.4], 300) + 0.1  # no row is sure, so pure targets lie outside
    n = rng.integers(1, 300, 300)
    present = n @ p
    targets = np.array([0.98, 0.01, 0.01]) * n.sum()
    fit = mixing.fitted(_known(spark, p, n), targets, most)
    rate = mixing._rates(p, fit.steps, most)
    assert not fit.reached and rate.min() >= 0 and (most is None or rate.max() <= most)
    assert fit.residual == pytest.approx(np.abs((rate * n) @ p - targets).sum() / targets.sum(), rel=1e-6)
    # conditions of the bounded minimum: the gradient is up at the lower bound, down at the upper, and nothing between
    up = p @ (((rate * n) @ p - targets) / present)
    inside = (rate > 0) if most is None else (rate > 0) & (rate < most)
    slack = 2 * np.sqrt(mixing.GAP) * np.abs(((rate * n) @ p - targets) / present).max()
    assert np.abs(up[inside]).max(initial=0) < slack and up[rate == 0].min(initial=0) > -slack
    if most is not None:
        assert up[rate == most].max(initial=0) < slack


def test_mixing_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 5 == 0) for i in range(1, 17)] + [(None, True, True), (4, None, None)], "doc_id long, q boolean, t boolean")
    labels = labels.select("doc_id", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic"))
    got = mixing.mixed(awkward, labels)
    assert got.count() == len(awkward_rows())
    assert got.where("rate is null or rate < 0 or copies < floor(rate) or copies > ceil(rate)").count() == 0
    assert got.where("abs(p_clean + p_junk + p_toxic - 1) > 1e-9").count() == 0
    assert mixing.mixed(empty, labels).count() == 0
    kept = mixing.thinned(awkward, labels)
    assert kept.dtypes == awkward.dtypes and kept.where("text is null").count() == 2
    assert mixing.thinned(awkward, labels.limit(0)).columns == awkward.columns


# -- packing ------------------------------------------------------------------


def naive_pack(rows, capacity, per_source):
    """Best-fit decreasing by scanning every bin."""
    bins, where = [], {}
    for i, (doc_id, n, source, cluster) in enumerate(sorted(rows, key=lambda r: (-(r[1] % capacity), r[0], r[3]))):
        rest = n % capacity
        if not rest:
            continue
        fits = [(capacity - b["used"], k) for k, b in enumerate(bins) if b["used"] + rest <= capacity and b["sources"][source] < per_source and cluster not in b["clusters"]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "sources": collections.Counter(), "clusters": set()})
        bins[k]["used"] += rest
        bins[k]["sources"][source] += 1
        bins[k]["clusters"].add(cluster)
        where[doc_id] = k
        del i
    return where


def test_best_fit_equals_naive_search():
    import pandas as pd

    rng = random.Random(4)
    for per_source in (1, 2, 3):
        rows = [(i, rng.choice([0, 5, 17, 40, 40, 99, 100, 230]) or rng.randrange(1, 100), rng.choice("abc"), rng.randrange(12)) for i in range(150)]
        frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "source", "cluster"]).assign(shard=0)
        out = packing.pack_shard(frame, 100, per_source)
        rests = out[(out["end"] - out["begin"]) < 100]
        assert dict(zip(rests["doc_id"], rests["bin"], strict=True)) == naive_pack(rows, 100, per_source)
        full = out[(out["end"] - out["begin"]) == 100]
        assert full["bin"].is_unique and not set(full["bin"]) & set(rests["bin"])


def test_packing_invariants(spark, awkward, empty):
    got = packing.packed(awkward, capacity=64, per_source=2, shard_docs=9).collect()
    words = collections.Counter()
    bins = collections.Counter()
    for r in got:
        words[r["doc_id"]] += r["n_words"]
        assert r["end"] - r["begin"] == r["n_words"] and (r["bin_id"] is None) == (r["n_words"] == 0)
        if r["bin_id"] is not None:
            bins[r["bin_id"]] += r["n_words"]
    expected = collections.Counter()
    for r in awkward_rows():
        expected[r[0]] += len(split_words(r[1]))
    assert words == expected and max(bins.values()) <= 64
    assert len({(r["bin_id"], r["place"]) for r in got if r["bin_id"] is not None}) == sum(r["bin_id"] is not None for r in got)
    assert packing.packed(empty).count() == 0


# -- archives -----------------------------------------------------------------

PAGES = [
    (5, "http://a.example/x", "<html>same</html>"), (3, "http://b.example/\r\ny z", "<html>same</html>"), (9, None, "<html>same</html>"),
    (4, "http://c.example/", None), (7, "http://c.example/", ""), (1, "http://d.example/", "é" * 200_000), (2, "http://e.example/", "a\r\n\r\nb"),
    (None, "http://f.example/", "<html>same</html>"), (None, None, "only without an id"), (6, "http://g.example/", "twice"), (6, "http://g.example/", "twice"), (-8, "u", "negative"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, sha string, first long").repartition(3)
    got = warc.archived(spark, pages).collect()
    assert len(got) == len(PAGES) and all(r["problem"] is None for r in got)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and to != i
        expected.append((i, len(data), warc.digest(data), "revisit" if again else "response", to if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(expected, key=str)
    assert warc.archived(spark, pages.limit(0)).count() == 0
    long = warc.archived(spark, pages, least_bytes=10).where("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in long} == {5, 9, None}


def test_reader_finds_damage():
    one, two = warc.record(1, "u", b"first", None, False, "d"), warc.record(2, "u", b"second" * 9999, None, False, "d")
    good = list(warc.records(io.BytesIO(one + two), keep=True))
    assert [(r.offset, r.payload, r.problem) for r in good] == [(0, b"first", None), (len(one), b"second" * 9999, None)]
    import gzip

    plain = gzip.decompress(one)
    assert [r.problem for r in warc.records(io.BytesIO(gzip.compress(plain.replace(b"first", b"fir5t")) + two))] == ["block digest", None]
    assert [r.problem for r in warc.records(io.BytesIO(one + two[:-20]))] == [None, "truncated"]
    assert [r.problem for r in warc.records(io.BytesIO(one + b"no gzip at all"))] == [None, "compression"]
    assert list(warc.records(io.BytesIO(b""))) == []


# -- nearest neighbours -------------------------------------------------------


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(600 + i, rows[40][1]) for i in range(30)]  # equal vectors
    rows += [rows[7], (900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0] * 3), (None, [1.0] * 16), (920, [float("inf")] * 16), (940, [])]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    got = neighbours.nearest(table.where("vec_id % 20 = 0"), table, 20)
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = dict(rows[:630])
    assert set(by) == {i for i in usable if i % 20 == 0}
    hit = []
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        exact = sorted(((-float(np.dot(usable[q], v)), i) for i, v in usable.items() if i != q))[:20]
        assert all(abs(s - float(np.dot(usable[q], usable[i]))) < 1e-9 for _, i, s in found)
        hit.append(len({i for _, i in exact} & {i for _, i, _ in found}) / 20)
    assert np.mean(hit) > 0.9
    assert [i for _, i, _ in by[40]] == list(range(600, 620))
    assert neighbours.nearest(table, table.limit(0), 3).count() == 0 and neighbours.nearest(table.limit(0), table, 3).count() == 0


def test_neighbours_of_small_tables_and_unequal_lengths(spark):
    def recall(x, asked, full, search=neighbours.Search()):
        table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        by = collections.defaultdict(dict)
        for r in neighbours.nearest(table.where(f"vec_id < {asked}"), table, 20, search).collect():
            by[r["query_id"]][r["rank"]] = r["vec_id"]
        hit = []
        for q in range(asked):
            exact = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
            assert sorted(by[q]) == list(range(1, len(exact) + 1))
            assert not full or [by[q][k + 1] for k in range(len(exact))] == exact
            hit.append(len(set(exact) & set(by[q].values())) / len(exact))
        return np.mean(hit)

    rng = np.random.default_rng(7)
    assert recall(rng.normal(size=(15, 64)), 15, True) == 1
    unit = rng.normal(size=(3000, 64))
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    one = unit.copy()
    one[1234] *= 100
    found = recall(one, 75, False), recall(unit * rng.lognormal(size=(3000, 1)), 75, False)
    print("recall", found)
    assert min(found) > 0.95
    # bands that are hashed, and visits that find too little
    few = neighbours.Search(tables=2, probes=4)
    recall(one[:, :16], 75, False, few)
    assert recall(np.concatenate([np.eye(64), -np.eye(64)]), 20, False, neighbours.Search(tables=1, probes=1)) > 0


def test_perturbations_come_in_order():
    sets = neighbours.perturbations(5, 60)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == 60
    assert all(len({min(r, 9 - r) for r in s}) == len(s) for s in sets)


def test_groups_split_when_large(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = neighbours.Search(task=20, least_groups=2)
    a = neighbours.nearest(table.where("vec_id < 20"), table, 5, small).collect()
    b = neighbours.nearest(table.where("vec_id < 20"), table, 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# -- language -----------------------------------------------------------------


def test_language_evidence(spark):
    rng = random.Random(8)
    english, german = "the and with that house river cloud".split(), "und das nicht schon fluss wolke haus".split()
    docs = spark.createDataFrame([(" ".join(rng.choice(w) for _ in range(60)), lang) for w, lang in ((english, "en"), (german, "de")) for _ in range(20)] + [(None, "fr"), ("x", None)], "text string, lang string")
    pages = [(i, "https://www.haus.de/a", f"<html lang='de'><p>{' '.join(rng.choice(german) for _ in range(20))}</p>") for i in range(20)]
    pages += [(100 + i, "http://river.com/", f"<html><script>und das nicht</script>{' '.join(rng.choice(english) for _ in range(20))}") for i in range(20)]
    pages += [(200, "https://www.haus.de/b", None), (201, "https://mail.haus.de/", ""), (202, None, None), (203, "https://www.haus.de/c", "<html lang=en>the and with that house river cloud the and with"), (None, "http://river.com/", "<p></p>"), pages[0]]
    got = language.languages(spark.createDataFrame([(*p, "n0", 1.0) for p in pages], "page_id long, url string, html string, declared string, p double"), docs)
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(pages)
    assert all(by[i]["lang"] == "de" for i in range(20)) and all(by[100 + i]["lang"] == "en" for i in range(20))
    assert by[200]["lang"] == "de" and by[201]["lang"] == "de"  # the host, then its parent domain, decide
    assert by[203]["lang"] == "en"  # a text of its own outweighs its host
    assert by[None]["lang"] == "en" and all(0 < r["probability"] <= 1 for r in by.values())
    assert language.languages(spark.createDataFrame(pages[:2], "page_id long, url string, html string"), docs.limit(0)).where("lang is null").count() == 2
    assert language.languages(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def test_visible_text_and_hosts(spark):
    assert language.visible("<html><!-- x --><style>p{}</style><p>a</p>b<SCRIPT src=1>q</SCRIPT >").split() == ["a", "b"]
    row = spark.sql("select 'HTTPS://user@Www.Example.DE:80/p?x#y' u, '<!doctype html><HTML class=x LANG=\"De-AT\">' h").select(language.host(F.col("u")), language.declared_language(F.col("h"))).first()
    assert tuple(row) == ("www.example.de", "de")


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty, tmp_path):
    labels = [(i, 1, 0) for i in range(1, 17)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (awkward, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == rows.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() if rows is empty else docs.count() > 5


def test_pipeline_on_documents(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id").where("quality = 1 and toxic = 0").select("doc_id")
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 5, 80).collect()}
    clean = [r["doc_id"] for r in labels.collect()]
    lost = [i for i in clean if i not in ids and groups[i] == i]
    assert len(lost) <= 0.1 * len(clean)
