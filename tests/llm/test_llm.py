"""Operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chains as C
from tidemark.llm import encoding as E
from tidemark.llm import grams as G
from tidemark.llm import mixing, packing, queries
from tidemark.llm.cooccurrence import Null, cooccurring, poisson_binomial_tail
from tidemark.llm.frequency import mark, term_frequencies
from tidemark.llm.tokens import count_tokens, encoder

SMALL = "/root/testdata/sf0.001"

# -- tokens and packing -------------------------------------------------------------------------------------------


def test_token_counts(spark):
    texts = ["Hello world, it's fine.", "", None, "   ", "日本語のテキスト", "word " * 30_000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("n_tokens", F.lit(7))
    got = {r["k"]: r["n_tokens"] for r in count_tokens(df, "t", ["k"]).collect()}
    enc = encoder()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_nnls_solves_and_stays_non_negative():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    x = np.zeros(30)
    x[[3, 8, 20]] = [1.0, 4.0, 2.5]
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    assert not packing.nnls(-a, np.ones(12)).any()


def test_patterns_are_all_partitions():
    got = packing.patterns(8, 3)
    assert len(got) == len(set(got)) == 10 and all(sum(p) == 8 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_places_everything_once(lengths):
    h = np.bincount(np.array(lengths, int), minlength=33) if lengths else np.zeros(33, np.int64)
    blocks = packing.plan_blocks(h, 32, 8, 3)
    placed = Counter()
    for b in blocks:
        used = sum(x * c for x, c in b.slots)
        assert b.n > 0 and used + b.space == 32 and b.space >= 0
        for x, c in b.slots:
            placed[x] += b.n * c
    assert placed == Counter(lengths)
    rows = packing.intervals(blocks)
    assert len(rows) == 0 or sum(b.n for b in blocks) <= len(lengths)


def best_fit(lengths, capacity):
    """Containers of best-fit decreasing, one item after another."""
    space = []
    for x in sorted(lengths, reverse=True):
        at = min((i for i, s in enumerate(space) if s >= x), key=lambda i: space[i], default=None)
        if at is None:
            space.append(capacity - x)
        else:
            space[at] -= x
    return len(space)


def test_pack_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["film", "plot", "actor", "scene"]) for _ in range(rng.choice([rng.randint(1, 30), rng.randint(10, 200), 700]))) for _ in range(400)] + [None, "", "word " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, container_id string")
    out = packing.pack(df, "doc_id", "text", capacity=256).collect()
    enc = encoder()
    size, parts = defaultdict(int), defaultdict(list)
    for r in out:
        size[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part"], r["first_token"], r["n_tokens"]))
    assert max(size.values()) <= 256 and set(size) == set(range(len(size)))
    for i, t in enumerate(texts):
        n = len(enc.encode_ordinary(t)) if t else 0
        assert sum(p[2] for p in parts[i]) == n and (n > 256 or len(parts[i]) == (1 if n else 0))
        assert [p[1] for p in sorted(parts[i])] == list(range(0, n, 256))
    assert len(size) <= 1.01 * best_fit([p[2] for ps in parts.values() for p in ps], 256) + 1
    report = packing.pack_report(packing.pack(df, "doc_id", "text", capacity=256), 256).first()
    assert report["containers"] == len(size) and report["fullest"] <= 256


def test_pack_one_length_and_empty(spark):
    df = spark.createDataFrame([(1, "same text here") for _ in range(500)], "doc_id long, text string")
    assert packing.pack(df, "doc_id", "text", 64).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= 64
    assert packing.pack(df.where("false"), "doc_id", "text").count() == 0
    assert packing.pack_report(packing.pack(df.where("false"), "doc_id", "text")).first()["containers"] == 0


# -- mixing ------------------------------------------------------------------------------------------------------------


def test_rake_meets_margins():
    rng = np.random.default_rng(2)
    tokens = rng.integers(50, 200, (3, 2, 4)).astype(float)
    total = tokens.sum()
    targets = np.array([0.5, 0.3, 0.2]) * total
    copies = mixing.rake(tokens, targets, np.array([5.0, 5.0, 5.0]))
    got = copies * tokens
    assert np.allclose(got.sum(axis=(1, 2)), targets, rtol=1e-4)
    assert np.allclose(got.sum(axis=(0, 2)), tokens.sum(axis=(0, 2)), rtol=1e-2) and np.allclose(got.sum(axis=(0, 1)), tokens.sum(axis=(0, 1)), rtol=1e-2)
    capped = mixing.rake(tokens, targets, np.array([1.0, 5.0, 5.0]))
    assert capped[0].max() <= 1.0 and np.allclose((capped * tokens)[1:].sum(axis=(1, 2)), targets[1:], rtol=1e-4)
    assert not mixing.rake(np.zeros((1, 1, 1)), np.zeros(1), np.ones(1)).any()


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")


def test_mix_reaches_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c"]), rng.choice(["en", "de"]), rng.choice(["x", "y"]), rng.randint(1, 60)) for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.15, 1), ("none", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(corpus(spark, rows), targets, "doc_id")
    total, of = sum(r[4] for r in rows), {r["source"]: r for r in report.collect()}
    got = {r["source"]: (r["t"], r["c"]) for r in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()}
    for s, share in (("a", 0.5), ("b", 0.3)):
        assert of[s]["reachable"] and abs(got[s][0] - share * total) <= 0.003 * total and got[s][0] == of[s]["selected_tokens"]
    assert got["a"][1] <= 1 and got["b"][1] <= 5 and got["c"][1] == 1
    assert not of["c"]["reachable"] and got["c"][0] == sum(r[4] for r in rows if r[1] == "c")
    assert not of["none"]["reachable"] and of["none"]["selected_tokens"] == 0
    assert selection.count() == selection.select("doc_id").distinct().count()
    again = mixing.mix(corpus(spark, rows), targets, "doc_id")[0]
    assert again.exceptAll(selection).count() == 0


def test_mix_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    for rows in ([], [(1, "other", "en", "x", 5)], [(1, "a", "en", "x", 0)]):
        selection, report = mixing.mix(corpus(spark, rows), targets, "doc_id")
        assert selection.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] == 0 and report.count() == 1
    selection, report = mixing.mix(corpus(spark, [(1, "a", "en", "x", 5)]), targets.where("false"), "doc_id")
    assert selection.count() == 0 and report.count() == 0
    langs = spark.createDataFrame([("en-GB",), (" DE",), ("english",), (None,), ("pt_BR",)], "c string").select(mixing.language(F.col("c"))).collect()
    assert [r[0] for r in langs] == ["en", "de", "und", "und", "pt"]


# -- frequency ----------------------------------------------------------------------------------------------------------


def test_term_frequencies(spark, rows):
    rng = random.Random(6)
    data = [(rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice([1, 2, 3, None]), rng.choice([0.0, -0.0, 1.5, float("nan"), None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "term string, r long, x double")
    norm = lambda x: "nan" if x is not None and x != x else None if x is None else x + 0.0
    occ, recs = Counter(t for t, _, _ in data), defaultdict(set)
    for t, r, x in data:
        recs[t].add((r, norm(x)))
    for batch in ("20000", "13"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequencies(df, "term", ["r", "x"]).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        assert got == {t: (occ[t], len(recs[t])) for t in occ}
    assert rows(term_frequencies(df.where("false"), "term", ["r"])) == []
    long = spark.createDataFrame([("x" * 100_000, 1), ("x" * 100_000, 1), ("", 1)], "t string, c0 long")
    assert rows(term_frequencies(long, "t", ["c0"]).select("occurrences", "records")) == [(1, 1), (2, 1)]
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (9,)], "n long").select(mark(F.col("n"), 3, F.lit(8))).collect()] == ["rare", None, "common"]


def test_genre_marks_against_brute_force(spark):
    movies = duckdb.sql(f"select genres from '{SMALL}/movies.parquet'").fetchall()
    got = {r["val"]: r["records"] for r in queries.p5_terms(spark, SMALL).where("field = 'genre'").collect()}
    whole = Counter(g.strip().lower() for (g,) in movies if g and g.strip().isalpha())
    assert all(got.get(g, 0) >= n for g, n in whole.items()) and "n/a" not in got and "-" not in got and "" not in got


# -- co-occurrence --------------------------------------------------------------------------------------------------------


def test_poisson_binomial_tail_against_exact_convolution():
    rng = np.random.default_rng(5)
    m = np.array([40, 25, 10])
    q = rng.random((6, 3)) * np.array([0.02, 0.1, 0.3])
    for row in q:
        exact = np.array([1.0])
        for p, k in zip(row, m):
            for _ in range(k):
                exact = np.convolve(exact, [1 - p, p])
        n = np.array([1, 2, 4, 8, 12, 20, 30])
        tail = exact[::-1].cumsum()[::-1][n]
        got = poisson_binomial_tail(np.tile(row, (len(n), 1)), m, n)
        assert np.allclose(got, np.log10(tail), atol=0.03)
    assert poisson_binomial_tail(np.array([[0.1]]), np.array([5]), np.array([0]))[0] == 0 and poisson_binomial_tail(np.array([[0.1]]), np.array([5]), np.array([6]))[0] == -np.inf


def test_null_reproduces_degrees():
    sizes, freqs = {1: 50, 2: 40, 3: 20, 6: 5}, {1: 40, 4: 15, 10: 4, 24: 2.0}
    total = sum(k * n for k, n in sizes.items())
    freqs[26.0] = (total - sum(k * n for k, n in freqs.items())) / 26
    null = Null(sizes, freqs)
    number = np.array([freqs[f] for f in sorted(freqs)])
    p = null.probability(np.array(sorted(freqs)))
    assert np.allclose((p * null.m).sum(axis=1), sorted(freqs), rtol=1e-5) and np.allclose((p * number[:, None]).sum(axis=0), null.k, rtol=1e-5)


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_against_brute_force(spark, block):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 12), rng.choice([5, 5, 6, 7, 8, 9, 10, 11, None])) for _ in range(900)]
    df = spark.createDataFrame(data, "b0 long, day long, item long").withColumn("f", F.lit(1))
    baskets = defaultdict(set)
    for u, d, i in data:
        if u is not None and i is not None:
            baskets[u, d].add(i)
    n, single, pair = len(baskets), Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        pair.update(combinations(sorted(b), 2))
    got = {(r["item_a"], r["item_b"]): r for r in cooccurring(df, [F.col("b0"), F.col("day")], "item", 2, block=block).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == {k: v for k, v in pair.items() if v >= 2}
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n_baskets"]) == (single[a], single[b], n) and r["lift"] == pytest.approx(pair[a, b] * n / single[a] / single[b])
        assert 0 <= r["q_value"] <= 1 and r["log10_p"] <= 0
    lifted = {(r["item_a"], r["item_b"]) for r in cooccurring(df, [F.col("b0"), F.col("day")], "item", 2, min_lift=2, block=block).collect()}
    assert lifted == {k for k, v in pair.items() if v >= 2 and v * n >= 2 * single[k[0]] * single[k[1]]}


def test_planted_pair_is_surprising(spark):
    rng = random.Random(8)
    rows = [(b, rng.randint(1, 60)) for b in range(2000) for _ in range(3)] + [(b, i) for b in range(0, 2000, 50) for i in (100, 101)]
    got = {(r["item_a"], r["item_b"]): r for r in cooccurring(spark.createDataFrame(rows, "b long, item long"), [F.col("b")], "item", 2).collect()}
    assert got[100, 101]["surprising"] and got[100, 101]["q_value"] < 1e-6
    others = [r["surprising"] for k, r in got.items() if k != (100, 101)]
    assert sum(others) <= 0.02 * len(others)


def test_q_values_do_not_depend_on_what_is_asked(spark):
    rng = random.Random(9)
    rows = [(b, rng.randint(1, 20)) for b in range(600) for _ in range(3)] + [(b, 100 + b // 3 * 2 + i) for b in range(90) for i in (0, 1)]
    rows += [(b, i) for b in range(7) for i in (200, 201)] + [(b, 200 + b % 2) for b in range(100, 126)]
    df = spark.createDataFrame(rows, "b long, item long")
    of = lambda *a: {(r["item_a"], r["item_b"]): (r["q_value"], r["surprising"]) for r in cooccurring(df, [F.col("b")], "item", *a).collect()}
    every = of(1)
    for asked in (of(6), of(2, 2)):
        assert asked and asked == {k: every[k] for k in asked}


def test_pairs_edges(spark):
    empty = spark.createDataFrame([], "u long, item long")
    assert cooccurring(empty, [F.col("u")], "item", 1).count() == 0
    one = spark.createDataFrame([(1, 5), (1, 5), (2, None), (None, 5)], "u long, item long")
    assert cooccurring(one, [F.col("u")], "item", 1).count() == 0


def test_p2_found_runs_the_whole_method(spark, monkeypatch, tmp_path):
    rows = [(b, i) for b in range(6) for i in (1, 2)] + [(b, 3 + b % 5) for b in range(6, 200)]
    df = spark.createDataFrame([(b, i, 0.0, 1.0) for b, i in rows], "user long, item long, tstamp double, rating double")
    df.write.parquet(f"{tmp_path}/interactions.parquet")
    fitted, tail = [], Null.log10_tail
    made = Null.__init__
    monkeypatch.setattr(Null, "__init__", lambda null, *a: [made(null, *a), fitted.append(null)][0])
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [(1, 2)]
    assert len(fitted) == 1 and tail(fitted[0], np.array([6]), np.array([6]), np.array([6]))[1][0] < -4


def test_p2_pairs_has_every_pair(spark):
    met = duckdb.sql(f"""with d as (select distinct "user" as u, floor(tstamp / 86400) as day, item from '{SMALL}/interactions.parquet' where "user" is not null and item is not null and tstamp is not null)
        select a.item, b.item, count(*) from d a join d b on a.u = b.u and a.day = b.day and a.item < b.item group by 1, 2""").fetchall()
    assert {(r["item_a"], r["item_b"], r["n_ab"]) for r in queries.p2_pairs(spark, SMALL).collect()} == set(met)


# -- wrongly decoded text --------------------------------------------------------------------------------------------------


def clean_texts(folder="/root/testdata/sf0.01", least=0):
    rows = duckdb.sql(f"select text from '{folder}/documents.parquet' where text is not null order by doc_id").fetchall()
    return [t for (t,) in rows if E.looks_clean(t) and not t.isascii() and len(t) > least]


@pytest.fixture(scope="module")
def judged():
    texts = clean_texts("/root/testdata/sf0.1")
    train, held = texts[::2], texts[1::2][:600]
    model = G.Model(*G.count_grams(train, [E.fold(t) for t in train]))
    return model, E.Judge(model, E.validated(model, train[:1000])), held


def test_held_out_accuracy(judged):
    _, judge, held = judged
    rng = random.Random(11)
    hits = wrong = garbled = clean = 0
    for t in held:
        bad = E.garble_all(t, rng)
        if bad != t:
            garbled += 1
            hits += judge.judge(bad)[0]
        clean += 1
        wrong += judge.judge(t)[0]
    assert hits >= 0.93 * garbled and wrong <= 0.02 * clean


def test_restores_round_trips(judged):
    _, judge, held = judged
    ok = n = 0
    for t in held[:80]:
        for read in ("cp1252", "latin_1", "cp1251", "mac_roman"):
            bad = C.from_bytes(t.encode("utf_8"), read)
            found, _, restored = judge.judge(bad)
            if not E._HARD.search(bad):
                n += 1
                ok += found and restored == t
    assert n and ok >= 0.9 * n


@pytest.mark.parametrize("text, garbled", [(None, False), ("", False), ("   ", False), ("plain ASCII text", False), ("a � b", True), ("it\x92s", True), ("line\x85next", False), ("Tom &amp; Ann, caf&eacute;", False)])
def test_hard_signs_and_clean_edges(judged, text, garbled):
    assert judged[1].judge(text)[0] is garbled


def test_codecs_invert():
    for read in C._TABLES:
        raw = bytes(range(256))
        assert C.to_bytes(C.from_bytes(raw, read), read) == raw


def test_chains_on_arrays_equal_those_on_strings():
    texts = ["für", "привет", "Ð¿Ñ€Ð¸Ð²ÐµÑ‚", "Êàê", "日本語の", "abcé", "ÏÐÈÂÅÒ", "x😀é", "ƒeƒXƒg‚·‚é日本éàx", "é", "\x00é"]
    texts += [s for t in clean_texts()[:60] for s in E.stretches(t)]
    got = [{} for _ in texts]
    for n, which, flat in C.legacy_many(texts, C.Flat.of(texts)):
        made = flat.points.tobytes().decode("utf_32_le", "surrogatepass")
        for i, start, length in zip(which, flat.starts, flat.lengths):
            got[i][n] = made[start + 2 : start + length - 1]
    assert got == [{n: x for n, x in enumerate(C.legacy_texts(t)) if x is not None} for t in texts]


def test_gram_counts_against_brute_force():
    texts = ["ab  abc", "ab\tab9", "", "x" * 5]
    want = [Counter() for _ in range(3)]
    for t in texts:
        seen = " " + " ".join(t.split()).replace("9", "0") + " " if t else " "
        for n in (1, 2, 3):
            want[n - 1].update(seen[i : i + n] for i in range(len(seen) - n + 1))
    model = G.Model(*G.count_grams(texts, [0, 1, 2, 1]))
    for n, counts in enumerate(want, 1):
        for gram, many in counts.items():
            code = 0
            for c in gram:
                code = (code << 21) | ord(c)
            assert model.count(n, np.array([code]))[0, -1] == many
    assert model.count(1, np.array([ord("x")]))[0].tolist() == [5.0, 0.0, *[5.0] * 7]


def test_best_runs_against_the_loop():
    rng = np.random.default_rng(5)
    added = rng.normal(-0.5, 3, (400, 7))
    starts = np.array([0, 3, 4, 250])
    want = []
    for a, b in zip(starts, [*starts[1:], 400]):
        chain, first, last = E._likeliest_run(added[a:b])
        want.append(added[a:b][first : last + 1, chain].sum())
    assert np.allclose(E.best_runs(added, starts), want)


def test_one_gap_by_list_equals_search(judged):
    model = judged[0]
    gaps = E.Gaps(model)
    bad = [C.from_bytes(bytes(b for b in w.encode() if b not in C.LOST_BYTES), "latin_1") for t in clean_texts()[:200] for w in E.stretches(t) if len(w) < 20]
    once = [(t, found) for t in dict.fromkeys(bad) if (found := E.put_back_once(t, gaps))]
    assert len(once) > 50
    got = E.likeliest_lost([t for t, _ in once], model)
    for n, (t, found) in enumerate(once):
        score = dict(zip(found, model.score(C.Flat.of(found), as_small=False)[0][:, -1]))
        best = max(score.values()) - 1e-3
        assert score[got[n]] >= best and score[E.put_back(t, model, gaps)] >= best, (t, got[n], E.put_back(t, model, gaps))


@pytest.mark.parametrize("blanks", [10, 400])
def test_all_lost_bytes_are_put_back(judged, blanks):
    """However many there are, and however long the stretch."""
    model, judge, _ = judged
    raw = "größere".encode()
    assert E.put_back(raw.replace(b"\x9f", b"").decode("latin_1").replace("Ã¶", "ö"), model, E.Gaps(model)) == "größere"
    many = "-".join(["größere"] * blanks)
    bad = C.from_bytes(bytes(b for b in many.encode() if b not in C.LOST_BYTES), "latin_1")
    assert len(bad) > blanks * 8 and judge.judge(bad)[0]


def test_rules_rest_on_all_clean_records(spark):
    texts = [f"größe {i} für über straße café naïve {i * 7}" for i in range(400)] + ["plain text", None, "bad \ufffd"]
    cell, counts = E.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    src = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    model = E.Model(cell, counts)
    assert E.validated_over(src, cell, counts) == E.validated(model, texts[:400])
    assert E.tallies(model, texts[:400])[0, 0, :, -1].sum() > E.tallies(model, texts[:150])[0, 0, :, -1].sum() > 0
    assert (E.tallies(model, texts[:150]) + E.tallies(model, texts[150:400]) == E.tallies(model, texts[:400])).all()
    assert E.validated_over(src.where("t is null"), cell, counts) == E.Rules()


def test_find_garbled_over_a_table(spark):
    texts = clean_texts()[:150]
    bad = [C.from_bytes(t.encode(), "cp1252") for t in texts[:30]]
    rows = [(i, t, "x") for i, t in enumerate([*bad, *texts[30:], None, "", "é" * 50_000])]
    out = {r["doc_id"]: r for r in E.find_garbled(spark.createDataFrame(rows, "doc_id long, text string, garbled string"), "doc_id", "text", sample=60).collect()}
    assert len(out) == len(rows) and sum(out[i]["garbled"] for i in range(30)) >= 29
    assert sum(out[i]["garbled"] for i in range(30, 150)) <= 6 and not out[150]["garbled"] and not out[151]["garbled"]
    assert E.find_garbled(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def kana_texts():
    return [t for t in clean_texts("/root/testdata/sf0.1") if sum(0x3040 <= ord(c) < 0x3100 for c in t) > 5 and not any(0xA1 <= ord(c) < 0x100 for c in t)]


def test_no_record_vouches_for_itself(spark):
    """A legacy chain that garbles a whole record and its copies: the record taught the model its own characters."""
    written, *texts = [t for t in kana_texts() if 20 < len(t) < 200]
    bad = C.from_bytes(written.encode("euc_jp", "ignore"), "latin_1")
    assert not E._HARD.search(bad)
    out = {r["doc_id"]: r for r in E.find_garbled(spark.createDataFrame(list(enumerate([bad, bad, bad, *texts])), "doc_id long, text string"), "doc_id", "text", sample=60).collect()}
    assert all(out[i]["garbled"] and out[i]["restored"] == written.encode("euc_jp", "ignore").decode("euc_jp") for i in range(3))
    assert sum(out[i]["garbled"] for i in range(3, 3 + len(texts))) <= 6


@pytest.mark.parametrize("written", ["euc_jp", "cp932", "utf_8"])
def test_part_of_a_stretch(judged, written):
    """Half of a sentence without blanks is garbled; the clean half is in no single-byte encoding."""
    left, right = "映像がとても良かったです。", "説明書は日本語でした。"
    bad = C.from_bytes(left.encode(written), "latin_1")
    assert C.to_bytes(bad + right, "latin_1") is None
    candidates = [o for o, _ in C.utf8_candidates(bad + right)] if written == "utf_8" else C.legacy_texts(bad + right)
    assert left + right in candidates
    if not E._HARD.search(bad):
        found, _, restored = judged[1].judge(bad + right)
        assert found and restored == left + right


# -- queries and SQL -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("interactions", "movies", "documents"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0
