"""The façade, persistence, streaming, serving, sources, caches and the driver's contract."""

import gzip
import json

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import experiment
from tidemark.cache import FrequencySet, SpillCache
from tidemark.models.factors import FactorConfig
from tidemark.models.recommender import NotFittedError, Recommender, Settings
from tidemark.operators import interactions as ops
from tidemark.serving import Service
from tidemark.sources import datasets
from tidemark.streaming.ingest import StateTable, json_interactions, start, stream_files

SMALL = "/root/testdata/sf0.001"
DATA = [(u, i, float(u * 10 + i), 5.0 if (u % 2) == (i % 2) else -1.0, u * 100 + i) for u in range(8) for i in range(6) if (u + 2 * i) % 5]
SCHEMA = "user long, item long, tstamp double, rating double, seq long"


@pytest.mark.parametrize("kind", ["linear", "factors", "hybrid"])
def test_recommender_round_trip(spark, tmp_path, rows, kind):
    df = spark.createDataFrame(DATA, SCHEMA)
    model = Recommender(spark, Settings(kind, factors=FactorConfig(dim=3, epochs=2, shards=2)))
    with pytest.raises(NotFittedError):
        model.recommend(df.select("user"), 3)
    # the hybrid has two models to fuse where tags are known
    tags = df.selectExpr("user as entity", "array(concat('g#', user % 2)) as tags").distinct() if kind == "hybrid" else None
    model.bulk_fit(df, user_tags=tags)
    users = spark.createDataFrame([(0,), (1,), (99,)], "user long")
    recs = model.recommend(users, 3)
    seen = {(r[0], r[1]) for r in DATA}
    got = recs.collect()
    assert all((r["user"], r["item"]) not in seen for r in got)
    assert sum(r["user"] == 99 for r in got) == 3  # an unknown user gets the hottest items
    assert model.recommend(users, 0).count() == 0
    model.save(str(tmp_path / "m"))
    again = Recommender.load(spark, str(tmp_path / "m"))
    assert rows(again.recommend(users, 3)) == rows(recs) and again.settings == model.settings
    found = model.evaluate(df.where("seq % 3 = 0"), 5).first()
    assert 0 <= found["ndcg"] <= 1
    assert model.similar_items(spark.createDataFrame([(0,), (777,)], "item long"), 3).where("query = 777").count() == 0


def test_batches_keep_positions_and_scores(spark):
    model = Recommender(spark)
    model.bulk_fit(spark.createDataFrame(DATA, SCHEMA))
    asked = spark.createDataFrame([(0, 3), (1, 99), (2, 0), (3, 3)], "pos long, user long")
    got = {r["pos"]: r for r in model.recommend_batch(asked, 2).collect()}
    one = [(r["item"], r["score"]) for r in model.recommend(asked.where("user = 3"), 2).orderBy("rank").collect()]
    assert [got[n]["user"] for n in range(4)] == [3, 99, 0, 3] and list(zip(got[0]["items"], got[0]["scores"])) == list(zip(got[3]["items"], got[3]["scores"])) == one
    hot = [(r["item"], float(r["freq"])) for r in ops.hot_items(model.pop, 2).orderBy("rank").collect()]
    assert list(zip(got[1]["items"], got[1]["scores"])) == hot


def test_hybrid_without_tags_is_linear(spark, rows):
    df = spark.createDataFrame(DATA, SCHEMA)
    users = spark.createDataFrame([(0,), (1,), (5,)], "user long")
    hybrid, alone = Recommender(spark, Settings("hybrid", factors=FactorConfig(dim=3, epochs=1, shards=1))), Recommender(spark)
    hybrid.bulk_fit(df)
    alone.bulk_fit(df)
    assert rows(hybrid.recommend(users, 3)) == rows(alone.recommend(users, 3))
    tagged = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, ["a"])], "entity long, tags array<string>")
    hybrid.register_tags(users=tagged)
    hybrid.clear_tags(users=tagged.where("entity = 1"))
    assert rows(hybrid.user_tags) == [(0, ["a"]), (2, ["a"])]
    hybrid.bulk_fit()
    plain, other = (rows(hybrid.recommend(users.where("user = 1"), 3, exclude_seen=False, user_tags=t).select("item", "score")) for t in (None, tagged.where("entity = 0").selectExpr("1L as entity", "tags")))
    assert plain != other  # the tags given for a known user count
    hybrid.clear_tags(users=True)
    assert hybrid.user_tags is None


def test_factor_increments_train_touched_pairs(spark):
    model = Recommender(spark, Settings("factors", factors=FactorConfig(dim=3, epochs=1, shards=2)))
    model.bulk_fit(spark.createDataFrame(DATA, SCHEMA))
    value = lambda: {(r["side"], r["feature"]): (r["bias"], tuple(r["vec"])) for r in model.params.collect()}
    before = value()
    model.fit(spark.createDataFrame([(3, 1, 500.0, 2.0, 9999), (77, 2, 500.0, 2.0, 10000)], SCHEMA))
    after = value()
    assert ("user", "id:77") in after and all(after[k] == v for k, v in before.items() if k not in {("user", "id:3"), ("item", "id:1"), ("item", "id:2")})


def test_fit_by_users_solves_their_items(spark):
    model = Recommender(spark)
    model.bulk_fit(spark.createDataFrame(DATA, SCHEMA))
    want = {(r["src"], r["dst"]): round(r["weight"], 9) for r in model.sim.collect()}
    model.fit_users(spark.createDataFrame([(3,)], "user long"))
    assert {(r["src"], r["dst"]): round(r["weight"], 9) for r in model.sim.collect()} == want


def test_increment_touches_only_its_items(spark):
    model = Recommender(spark)
    model.bulk_fit(spark.createDataFrame(DATA, SCHEMA))
    before = {(r["src"], r["dst"]): r["weight"] for r in model.sim.collect() if r["dst"] != 1}
    model.fit(spark.createDataFrame([(3, 1, 500.0, 2.0, 9999)], SCHEMA))
    after = {(r["src"], r["dst"]): r["weight"] for r in model.sim.collect() if r["dst"] != 1}
    assert before == after and model.clock == 501.0


def test_increments_carry_clock_and_arrival(spark, rows):
    day = 86400.0
    data = [(1, 1, 0.0, 5.0), (2, 1, 30 * day, 1.0), (1, 1, 1 * day, 2.0), (2, 2, 31 * day, 1.0), (3, 2, 32 * day, 1.0), (3, 1, 33 * day, 1.0)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(data)], SCHEMA)
    settings = Settings(state=ops.StateConfig(decay_in_days=10.0))
    once, twice = Recommender(spark, settings), Recommender(spark, settings)
    once.add(df)
    for lo, hi in ((0, 2), (2, 3), (3, 6)):
        twice.add(df.where((df.seq >= lo) & (df.seq < hi)))
    value = lambda m: {(r["user"], r["item"]): (round(r["value"], 9), r["tstamp"]) for r in m.state.collect()}
    assert value(once) == value(twice) and once.clock == twice.clock and rows(once.pop) == rows(twice.pop)
    # without numbers of arrival each call comes after the ones before, so popularity ends as by one call
    later = [(r[0], r[1], float(n), r[3]) for n, r in enumerate(data)]
    one, two = Recommender(spark), Recommender(spark)
    plain = spark.createDataFrame(later, "user long, item long, tstamp double, rating double")
    one.add(plain)
    two.add(plain.where("tstamp < 3"))
    two.add(plain.where("tstamp >= 3"))
    assert rows(one.pop) == rows(two.pop) and one.last_arrival == two.last_arrival == 5


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    for n in range(3):
        df.where((df.seq >= n * 300) & (df.seq < (n + 1) * 300)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = StateTable(spark, str(tmp_path / "state"))
    calls = []
    start(stream_files(spark, str(tmp_path / "in")), table, str(tmp_path / "cp"), after=lambda b, n: calls.append(n)).awaitTermination()
    want = {(r["user"], r["item"]): r["value"] for r in ops.fold(df).collect()}
    assert {(r["user"], r["item"]): r["value"] for r in table.read().collect()} == want and calls == [0, 1, 2]
    assert table.apply(df, 1) is False
    # later batches with late rows go on from the clock of all users, and rewrite only the buckets of their users
    config = ops.StateConfig(decay_in_days=10.0)
    day = 86400.0
    late = [(1, 1, 0.0, 5.0, 0), (2, 1, 30 * day, 1.0, 1), (1, 1, 1 * day, 2.0, 2), (3, 3, 2 * day, 4.0, 3)]
    whole = ops.fold(spark.createDataFrame(late, SCHEMA), config)
    table = StateTable(spark, str(tmp_path / "decayed"), config, buckets=4)
    for n in range(4):
        assert table.apply(spark.createDataFrame(late[n : n + 1], SCHEMA), n)
    value = lambda df: {(r["user"], r["item"]): (round(r["value"], 9), r["tstamp"]) for r in df.collect()}
    assert value(table.read()) == value(whole) and table.current["clock"] == 30 * day + 1
    assert table.apply(spark.createDataFrame([], SCHEMA), 4) and value(table.read()) == value(whole) and StateTable(spark, str(tmp_path / "none")).read() is None
    raw = spark.createDataFrame([(bytearray(b'{"user": 1, "item": 2, "tstamp": 3.0, "rating": 4.0, "seq": 5}'),), (None,)], "value binary")
    assert [tuple(r) for r in json_interactions(raw).where("user is not null").collect()] == [(1, 2, 3.0, 4.0, 5)]


def test_service(spark):
    s = Service(Recommender(spark), "secret")
    assert s.handle("GET", "/", None, b"") == (200, {"message": "Recommender System API is running"})
    rows = [{"user": f"u{u}", "item": f"i{i}", "timestamp": t, "rating": r} for u, i, t, r, _ in DATA]
    assert s.handle("POST", "/fit", "wrong", b"[]") == (400, {"detail": "Invalid X-Token header"})
    assert s.handle("POST", "/fit", "secret", json.dumps(rows).encode())[0] == 200
    status, out = s.handle("POST", "/recommend", "secret", json.dumps({"user": "u0", "top_k": 2}).encode())
    assert status == 200 and out["user"] == "u0" and len(out["recommendations"]) <= 2
    assert s.handle("POST", "/recommend", "secret", b"{}")[0] == 422 and s.handle("PUT", "/x", "secret", b"")[0] == 404


def test_sources(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t3\t100\n2\t11\t4\t50\n")
    (tmp_path / "u.item").write_text("10|Été (1999)|x|y|z|" + "|".join("1" if g in ("Drama", "War") else "0" for g in datasets.FILM_GENRES) + "\n", encoding="latin1")
    (tmp_path / "u.user").write_text("1|30|F|writer|123\n")
    out = datasets.films(spark, str(tmp_path), "100k", by_time=True, users=True, items=True).collect()
    assert [r["user"] for r in out] == [2, 1] and out[1]["genres"] == "Drama|War" and out[1]["title"] == "Été (1999)" and out[1]["age"] == 30 and out[0]["title"] is None
    (tmp_path / "ratings.dat").write_text("1::10::3.5::100\n")
    assert datasets.films(spark, str(tmp_path), "1m").first()["rating"] == 3.5
    (tmp_path / "b.json").write_text('{"user_id":"a","business_id":"b","stars":4.0,"date":"2020-01-02 10:00:00","text":"x"}\n')
    assert tuple(datasets.businesses(spark, str(tmp_path / "b.json")).first()) == ("a", "b", 1577923200.0, 4.0)
    with gzip.open(tmp_path / "Digital_Music_5.json.gz", "wt") as f:
        f.write('{"reviewerID":"r","asin":"p","overall":5.0,"unixReviewTime":7}\n{"reviewerID":"r","asin":"q","overall":5.0,"unixReviewTime":8,"image":["u"]}\n')
    got = [r["image_url"] for r in datasets.products(spark, str(tmp_path), images=True, by_time=True).collect()]
    assert got == ["http://images.amazon.com/images/P/p.01._SCTZZZZZZZ_.jpg", "u"] and datasets.products(spark, str(tmp_path), "all").first()["category"] == "Music"
    (tmp_path / "plays.tsv").write_text("u\tid\tname\t3\n")
    assert tuple(datasets.plays(spark, str(tmp_path / "plays.tsv")).first()) == ("u", "id", "name", 3)
    (tmp_path / "t.csv").write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-01-02,00000000000000000a,7,0.5,1\n")
    assert tuple(datasets.fashion(spark, str(tmp_path / "t.csv")).first()) == (10, 7, 1577923200.0, 1.0)
    for f, text in (("events.csv", "timestamp,visitorid,event,itemid,transactionid\n5000,1,view,3,\n1000,1,view,3,\n"), ("item_properties_part1.csv", "timestamp,itemid,property,value\n2000,3,categoryid,9\n"), ("item_properties_part2.csv", "timestamp,itemid,property,value\n6000,3,available,1\n"), ("category_tree.csv", "categoryid,parentid\n9,2\n")):
        (tmp_path / f).write_text(text)
    shop = {r["tstamp"]: r for r in datasets.shop(spark, str(tmp_path)).collect()}
    assert shop[5.0]["categoryid"] == "9" and shop[5.0]["parentid"] == "2" and shop[5.0]["rating"] == 1.0 and shop[1.0]["property"] is None
    with pytest.raises(ValueError):
        datasets.load(spark, "nope", "")
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, "yelp", str(tmp_path / "missing"))
    assert list(map(len, datasets.batches(spark.range(5), 2))) == [2, 2, 1]


def test_fashion_tags(spark):
    c = spark.createDataFrame([("0a", None, 1, "ACTIVE", "NONE", None, "p")], "customer_id string, FN byte, Active byte, club_member_status string, fashion_news_frequency string, age byte, postal_code string")
    assert datasets.fashion_user_tags(c).first()["tags"] == ["FN#0", "Active#1", "club_member#ACTIVE", "news_freq#NONE", "age#unknown", "postal_code#p"]
    a = spark.createDataFrame([tuple(range(25))], ", ".join(["article_id int", *(f"{col} int" for col in dict.fromkeys(x[1] for x in datasets.ARTICLE_TAGS))]))
    assert len(datasets.fashion_item_tags(a).first()["tags"]) == 12 and len(datasets.fashion_item_tags(a, texts=True).first()["tags"]) == 24


def test_experiment(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    for split in experiment.SPLITS:
        assert experiment.run(df, split=split, neighbours=None)["samples_per_second"] > 0
    with pytest.raises(ValueError):
        experiment.run(df, split="other")


def test_frequency_set():
    f = FrequencySet(5)
    for k in "ABCADEAB":
        f.add(k)
    assert f.top() == ["A", "B", "C", "D", "E"] and f.top(2, exclude=("A",)) == ["B", "C"]
    f = FrequencySet(3)
    for k in "abcaadc":
        f.add(k)
    assert f.top() == ["a", "c", "d"] and "b" not in f and len(f) == 3
    with pytest.raises(ValueError):
        FrequencySet(0)


def test_spill_cache(tmp_path):
    c = SpillCache(str(tmp_path / "c.db"), size=2)
    for i in range(5):
        c[str(i)] = [i]
    assert len(c) == 5 and c["0"] == [0] and "4" in c and c.get("x") is None
    del c["0"]
    with pytest.raises(KeyError):
        c["0"]
    c.clear()
    assert len(c) >= 1
    c.clear(memory_only=False)
    assert len(c) == 0
    c.close()


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CORE = [n for n, f in entry.queries().items() if n in entry.oracle_sql() and not f.__module__.startswith("tidemark.llm")]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    a = sorted((tuple(number(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(number(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b
