"""Periodic runs, vector codes and chat formatting against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import chats, codes, queries, runs

SF = "/root/testdata/sf0.001"


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- periodic runs ------------------------------------------------------------


def brute_lyndon(s):
    suffixes = [s[i:] for i in range(len(s))]
    return [next((j for j in range(i + 1, len(s)) if suffixes[j] < suffixes[i]), len(s)) - i for i in range(len(s))]


def brute_runs(w, exponent, least):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)  # the smallest period of a stretch comes first
            i = max(j, i) + 1
    return sorted((start, length, p) for (start, length), p in found.items())


def random_symbols(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 45))]
    if rng.random() < 0.6 and len(s) > 5:
        p, a = rng.randint(1, 7), rng.randrange(len(s))
        for i in range(a + p, len(s)):
            s[i] = s[i - p]
    return s


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(1)
    for _ in range(1500):
        s = random_symbols(rng)
        assert runs.lyndon_lengths(s) == brute_lyndon(s)
        assert runs.lyndon_lengths([-x for x in s]) == brute_lyndon([-x for x in s])


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 5), (4, 6)])
def test_runs_of_several_texts_equal_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = [[b"w%d" % x for x in random_symbols(rng)] for _ in range(4)]
        assert runs.runs_of(texts, exponent, least) == [brute_runs(t, exponent, least) for t in texts]


def test_words_and_ranks_of_fibonacci_and_one_word_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs_of([b], 2, 2) == [brute_runs(b, 2, 2)]
    assert runs.runs_of([[b"x"] * 50_000], 4, 6) == [[(0, 50_000, 1)]]


RUN_DOCS = "doc_id long, text string, runs int, collapsed int, best int, n_words int"


def test_periodic_runs_of_awkward_rows(spark):
    long = " ".join(["one", "two", "three"] * 120_000)
    texts = [None, "", " \t\n", "a a a a a a", "a a a a a", "x\ty x\ny x y  x y z", "été été été été été été fin", long]
    rows = [(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)] + [(3, texts[3], 9, 9, 9, 9), (None, texts[3], 0, 0, 0, 0)]
    got = runs.periodic_runs(spark.createDataFrame(rows, RUN_DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts[:-1]):
        want = brute_runs(split_words(t), 4, 6)
        assert [tuple(x) for x in by_id[i]["runs"]] == want and by_id[i]["n_words"] == len(split_words(t))
    assert by_id[0]["collapsed"] == "" and by_id[3]["collapsed"] == "a" and by_id[5]["collapsed"] == "x y z" and by_id[6]["collapsed"] == "été fin"
    assert [tuple(x) for x in by_id[7]["runs"]] == [(0, 360_000, 3)] and by_id[7]["collapsed"] == "one two three"
    assert by_id[None]["collapsed"] == "a" and sum(r["doc_id"] == 3 for r in got) == 2
    assert runs.periodic_runs(spark.createDataFrame([], RUN_DOCS)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], RUN_DOCS), exponent=1)


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            w = w[: rng.randrange(10)] + (w[:4] or ["q"]) * rng.randint(1, 8) + w[5:9]
        rows.append((i, None if i % 50 == 7 else rng.choice([" ", "\n", " \t"]).join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        w, h = split_words(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w, 4, 6)
        dropped = {j for s, ln, p in found for j in range(s + p, s + ln)}
        r = got[i]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{ln},{p}\n" for s, ln, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in dropped).encode()).hexdigest()
        if found:
            best = next(x for x in found if all(x[1] * y[2] >= y[1] * x[2] for y in found))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert planted > 20


# -- vector codes -------------------------------------------------------------


@pytest.mark.parametrize("spread", [2, 30, 5_000, 1 << 25])
def test_slices_find_the_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    for count in (1, 3, 64, 65, 256, 300):
        entries, rows = rng.integers(-spread, spread, (count, 7)), rng.integers(-2 * spread, 2 * spread, (600, 7))
        rows[:50] = entries[rng.integers(0, count, 50)]
        entry, distance = codes.Slices(entries).nearest(rows)
        square = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (entry == square.argmin(axis=1)).all() and (distance == square.min(axis=1)).all()


def test_slices_give_exactly_the_entries_within_the_radius():
    rng = np.random.default_rng(3)
    entries, rows = rng.integers(-50, 50, (130, 4)), rng.integers(-50, 50, (40, 4))
    radius = rng.integers(0, 60, 40)
    row, entry = codes.Slices(entries).within(rows, radius)
    inside = (abs(rows[:, None, :] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert (np.stack([row, entry]) == np.stack(np.nonzero(inside))).all() and len(row) < inside.size


def brute_codes(rows, parts, entries, rounds):
    x = np.array([v for _, v in rows])
    cuts = np.arange(parts + 1) * (x.shape[1] // parts)
    books = [x[:entries, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    for k in range(rounds + 1):
        near = []
        for p, book in enumerate(books):
            square = ((x[:, None, cuts[p] : cuts[p + 1]] - book[None]) ** 2).sum(axis=2)
            near.append((square.argmin(axis=1), square.min(axis=1)))
            if k < rounds:
                for e in set(near[p][0].tolist()):
                    mine = x[near[p][0] == e, cuts[p] : cuts[p + 1]]
                    book[e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    return near, books


VECTORS = "vec_id long, embedding array<float>, label int, steps int, code string, error long, width int"


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 8))
    data = [(i, [float(v) for v in np.float32(centre[i % 20] + 0.1 * rng.normal(size=8))], None if i % 7 == 0 else i % 3) for i in range(500)]
    table = spark.createDataFrame([(i, v, l, 0, "c", 1, 2) for i, v, l in data], VECTORS).repartition(5)
    for code in (codes.Code(4, 16, 3, 1024), codes.Code(2, 256, 1, 100)):
        steps = [(i, [int(np.floor(code.scale * x)) for x in v]) for i, v, _ in data]
        near, books = brute_codes(steps, code.parts, code.entries, code.rounds)
        rows, got_books = codes.vector_codes(table, code)
        got = {r["vec_id"]: r for r in rows.collect()}
        assert [b.tolist() for b in got_books] == [b.tolist() for b in books]
        error = sum(d for _, d in near)
        for at, (i, _, label) in enumerate(data):
            assert got[i]["code"] == "".join(f"{e[at]:02x}" for e, _ in near) and got[i]["error"] == error[at]
            assert got[i]["label_error"] == sum(int(error[j]) for j, r in enumerate(data) if r[2] == label)
        back = {r["vec_id"]: r["embedding"] for r in codes.decoded(rows, got_books, code).collect()}
        assert back[3] == [v / code.scale for p in range(code.parts) for v in books[p][near[p][0][3]].tolist()]


def test_vector_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1.0, 0.0]
    vectors = [good, good, [0.5, None, 1.0, 0.0], None, [nan, 0.0, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], [], [1.0, 2.0], [1e9, 0.0, 0.0, 0.0], [-0.0005, 0.0, 0.0, 0.0]]
    rows = [(i, v, None if i < 3 else 1, 0, "c", 1, 2) for i, v in enumerate(vectors)] + [(0, good, 1, 0, "c", 1, 2), (None, good, 2, 0, "c", 1, 2)]
    out, books = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(4), codes.Code(2, 4, 1, 1024))
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"]) for r in out.collect()), key=str)
    # The four first of (0, 0, 1, 9): three equal vectors share entry 0, the last is its own.
    assert got == sorted([(0, "0000", 0), (0, "0000", 0), (1, "0000", 0), (6, None, None), (7, None, None), (8, None, None), (9, "0303", 0), (-1, "0000", 0)], key=str)
    assert books[0][3].tolist() == [-1, 0]
    assert {r["label_error"] for r in out.collect()} == {0}
    out, books = codes.vector_codes(spark.createDataFrame([], VECTORS))
    assert out.collect() == [] and books == []
    odd, _ = codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], None, 0, "", 0, 0)], VECTORS), codes.Code(2, 4, 1, 1))
    assert [r["code"] for r in odd.collect()] == ["0000"]


# -- chat formatting ----------------------------------------------------------

HARD = ["", "\\", "\\\\h", "###", "####", "\\### Assistant: </turn> ok", "</turn>", "</role>", "</tur</turn>n>", "\\t\\h\\r", "### User: hi</turn>\n", " \n\n ", "é😀", "a\x00b", "#" * 7]


def test_escapes_are_undone():
    rng = random.Random(2)
    bits = ["\\", "#", "##", "###", "</turn>", "</role>", "h", "t", "r", "<", "/turn>", " ", "\n"]
    for text in HARD + ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]:
        made = chats.escaped(text)
        assert chats.unescaped(made) == text
        assert not any(c in made for c in ("###", chats.TURN_END, chats.ROLE_END))
    turns = [(rng.choice([*chats.HEADS, "tool", "</role>x", ""]), t) for t in HARD]
    text, spans = chats.rendered(turns)
    assert list(chats.parsed(text)) == turns
    assert [chats.unescaped(text[a:b]) for _, a, b in spans] == [t for _, t in turns]


def test_loss_mask_is_every_overlap():
    rng = random.Random(4)
    for _ in range(500):
        cuts = sorted(rng.sample(range(60), 12))
        tokens = [(a, b) for a, b in zip(cuts, cuts[1:])]
        edges = sorted(rng.sample(range(60), 6))
        spans = list(zip(edges[::2], edges[1::2])) + [(59, 59)]
        want = [any(max(a, c) < min(b, d) for c, d in spans) for a, b in tokens]
        assert chats.loss_mask(tokens, spans).tolist() == want
    assert chats.loss_mask([], [(0, 1)]).tolist() == [] and chats.loss_mask([(0, 1)], []).tolist() == [False]


TURNS = "conv_id long, turn long, role string, text string, part int, seq int, edge int, tokens int"


def test_conversations_read_back(spark):
    rng = random.Random(6)
    turns = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 9)):
            turns.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice([*HARD, None])))
    turns += [(900, t, "assistant", f"text {t} " * 40) for t in range(300)]  # a hot conversation, cut by pieces and ranges
    turns += [turns[0], turns[0], (901, None, "assistant", "x" * 50_000), (901, None, None, None)]
    table = spark.createDataFrame([(*t, 1, 2, 3, 4) for t in turns], TURNS).repartition(6)
    form = chats.Format(piece=2000)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/chat-test"
    chats.formatted(table, form).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    assert rows.where("conv_id = 900").count() > 5 and rows.where("conv_id = 900").select("part").distinct().count() > 1
    got = {r["conv_id"]: r for r in chats.read_back(rows, form).collect()}
    assert len(got) == 43
    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    for conv in got:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (low(t[1]), text(t[2]), text(t[3])))
        said = [(t[2] or "", t[3] or "") for t in mine]
        loss = "".join(x for role, x in said if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(chats.rendered(said)[0])
    empty = spark.createDataFrame([], TURNS)
    assert chats.formatted(empty).collect() == [] and chats.read_back(chats.formatted(empty)).collect() == []


def test_pieces_have_the_tokens_of_the_whole(spark):
    turns = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f" turn {t}\n " * 30) for t in range(40)], "conv_id long, turn long, role string, text string")
    pieces = chats.formatted(turns, chats.Format(piece=900)).orderBy("part", "seq").collect()
    said = [("assistant" if t % 2 else "user", f" turn {t}\n " * 30) for t in range(40)]
    text, spans = chats.rendered(said)
    code = chats.tokenizer(chats.Format().tokenizer).encode(text, add_special_tokens=False)
    assert len(pieces) > 5 and [i for p in pieces for i in p["tokens"]] == code.ids
    assert [m for p in pieces for m in p["loss"]] == chats.loss_mask(code.offsets, [(a, b) for r, a, b in spans if r == "assistant"]).tolist()


def test_changed_tokens_are_noticed(spark):
    rows = chats.formatted(spark.createDataFrame([(1, 0, "user", "hello there")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="tokens do not give back"):
        chats.read_back(rows.withColumn("tokens", F.slice("tokens", 1, 2))).collect()
