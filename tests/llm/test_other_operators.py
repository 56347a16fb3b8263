import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderlake.llm import chat, lattice, queries, urls

# Chat


def test_chat_equals_oracle(spark, sf, same):
    same(queries.op7_chat_formatting(spark, sf), queries.ORACLES["op7_chat_formatting"])


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes"), ("user", None)]
    rows = [(c, k + off, r, t, 1) for c, n, off in ((1, 2, 0), (2, 5, 0), (3, 4, 7), (4, 5, 0), (6, 1, 0)) for k, (r, t) in enumerate(turns[:n])]
    rows += [(5, 0, "user", "hi", 1), (5, 1, "assistant", "other", 1), (7, None, None, None, 1), (None, 0, "user", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {(r["conv"], r["part"]): r for r in chat.render(df, part=2).collect()}
    assert {c for c, _ in got} == {2, 5, 7} and got[2, 2]["rendered"] == "<|im_start|>user\n<|im_end|>\n" and got[2, 0]["n_turns"] == 5
    assert got[7, 0]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


# Embeddings


def brute(rows, least):
    ids = [r[0] for r in rows]
    unit = []
    for _, e, label in rows:
        v = np.array([np.nan if x is None else x for x in e], float) if e else np.zeros(1)
        unit.append(v / np.linalg.norm(v) if label is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0 else None)
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least for j in range(len(rows))] for i in range(len(rows))]
    comp = list(ids)
    for _ in rows:
        comp = [min([comp[i]] + [comp[j] for j in range(len(rows)) if near[i][j]]) for i in range(len(rows))]
    return sorted((ids[i], sum(near[i]), comp[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_embedding_links_equal_brute_force(spark, block_rows):
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + r.normal(size=16) * (0.12 if i % 3 else 0.0)], int(i % 2)) for i in range(90)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, rows[0][1], None), (105, [2 * x for x in rows[0][1]], 0), (106, [1.0, 2.0], 0), (107, [2.0, 4.0], 0), (108, [], 0)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, cell string, rep int")
    got = sorted((x["id"], x["n_links"], x["component_id"]) for x in lattice.near_duplicates(df, block_rows=block_rows).collect())
    assert got == brute(rows, 0.98)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    assert (np.isclose(p % 1, 0).all(axis=1) | np.isclose(p % 1, 0.5).all(axis=1)).all() and np.isclose(p.sum(axis=1) % 2, 0).all()
    ring = lattice.shortest()
    assert len(ring) == 240 and np.allclose((ring**2).sum(axis=1), 2)
    far = ((x - p) ** 2).sum(axis=1)
    assert all(far[i] <= ((x[i] - (p[i] + ring)) ** 2).sum(axis=1).min() + 1e-9 for i in range(200))


# URLs

URLS = [
    ("https://a.Example.NET/en/1?x=1#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://b.net", "b.net", "", None, "allow"), ("http://b.net/", "b.net", "/", "net/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/FR/", "x.org", "/FR/", None, "allow"), ("x.net/y", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?q", "", "", None, "allow"), ("a://b.net?u=c://d.org/fr/", "b.net", "", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h", "t") for i, u in enumerate(URLS)] + [(None, "http://b.net/", "h", "t")], "page_id long, url string, host string, items string")
    got = {r["id"]: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == verdict
    assert urls.judge(df.limit(0)).count() == 0 and got[None]["rule"] == "net/"


def test_mined_rules_fire_where_all_their_tokens_are(spark):
    labelled = [(f"http://s{i}.farm.example/buy/{i}", "block") for i in range(30)] + [(f"http://s{i}.farm.example/read/{i}", "allow") for i in range(30)] + [(f"http://t{i}.shop.example/buy/{i}", "allow") for i in range(30)]
    pages = spark.createDataFrame([(1, "http://z.farm.example/buy/9"), (2, "http://z.farm.example/read/9"), (3, "http://z.shop.example/buy/9")], "page_id long, url string")
    got = {r["id"]: r["verdict"] for r in urls.judge(pages, labels=spark.createDataFrame(labelled, "url string, verdict string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_a_hot_url_keeps_its_support_in_a_large_table(spark):
    n = 300_000
    rows = spark.range(n).withColumn("hot", F.col("id") % 3 == 0)
    hot = "http://a11.spam.example/buy"
    # Left out by a draw of 200,000 of these rows by a hash of the URL.
    assert rows.limit(1).select((F.pmod(F.xxhash64(F.lit(hot)), F.lit(1 << 30)) / float(1 << 30)).alias("share")).first()["share"] > 2 / 3
    labels = rows.select(F.when(F.col("hot"), hot).otherwise(F.concat(F.lit("http://s"), "id", F.lit(".fine.example/read"))).alias("url"), F.when(F.col("hot"), "block").otherwise("allow").alias("verdict"))
    pages = spark.createDataFrame([(1, "http://other.spam.example/buy"), (2, "http://other.fine.example/read")], "page_id long, url string")
    assert {r["id"]: r["verdict"] for r in urls.judge(pages, labels=labels).collect()} == {1: "block", 2: "allow"}


def test_rules_of_five_tokens_fire(spark):
    steps = ["a", "b", "c", "d", "e"]
    urls_of = ["http://x.example/" + "/".join(steps), *("http://x.example/" + "/".join(s for s in steps if s != out) for out in steps)]
    labelled = [(u, "allow" if k else "block") for k, u in enumerate(urls_of) for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
    got = {r["id"]: r["verdict"] for r in urls.judge(pages, labels=spark.createDataFrame(labelled, "url string, verdict string")).collect()}
    assert got == {0: "block", **dict.fromkeys(range(1, 6), "allow")}


def plain_rules(labelled, support, confidence):
    """All token sets that imply block, by counting every subset."""
    from itertools import combinations

    n, every, block = len(labelled), {}, {}
    for items, verdict in labelled:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                every[c] = every.get(c, 0) + 1
                block[c] = block.get(c, 0) + (verdict == "block")
    return {c: block[c] / every[c] for c in every if block[c] >= support * n and block[c] / every[c] >= confidence}


def test_mined_rules_equal_counting_all_subsets(spark):
    r = random.Random(11)
    rows = []
    for _ in range(300):
        items = sorted(r.sample("abcdefg", r.randint(1, 5)))
        items += ["z"] * ("a" in items)  # always with a
        rows.append((items, "block" if {"a", "b"} <= set(items) or "g" in items and r.random() < 0.93 else "allow"))
    want = plain_rules(rows, urls.LEAST_SUPPORT, urls.LEAST_CONFIDENCE)
    mined, classes = urls.mine(spark.createDataFrame(rows, "items array<string>, verdict string"))
    got = {tuple(x["items"]): x["confidence"] for x in mined.collect()}
    assert got and all(abs(want[k] - c) < 1e-12 for k, c in got.items()) and not any("z" in k for k in got)
    sets = [sorted(r.sample("abcdefg", r.randint(1, 6))) for _ in range(200)]
    sets = [x + ["z"] * ("a" in x and r.random() < 0.5) for x in sets] + [["b", "z"]]
    fired = urls.fired(spark.createDataFrame([(x,) for x in sets], "items array<string>").distinct(), mined, classes).collect()
    assert {tuple(x["items"]) for x in fired} == {tuple(x) for x in sets if any(set(k) <= set(x) for k in want)}
    for x in fired:
        hit = {"a" if i == "z" else i for i in x["items"]}
        names = sorted((-c, " & ".join(k)) for k, c in got.items() if set(k) <= hit)
        assert x["mined"] == names[0][1]


def test_rules_of_the_pages_themselves_judge_the_others(spark):
    pages = [f"http://h{i}.net/buy/{i}" for i in range(40)] + [f"http://h{i}.org/fr/read" for i in range(40)] + ["http://k.com/buy/1", "http://k.com/read", "http://k.com/other"]
    got = {r["id"]: (r["verdict"], r["mined"]) for r in urls.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")).collect()}
    assert got[80] == ("block", "host0:net") and got[81] == got[82] == ("allow", None)  # path:buy, named by the first token of its class
    assert {got[i] for i in range(40)} == {("block", None)} and {got[i] for i in range(40, 80)} == {("allow", None)}


# Pipeline


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    was, kept = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.Stored(stage(spark, was, sf), name).df
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        assert now.count() <= kept and now.count() >= 0.5 * docs.count()
        was, kept = now, now.count()
    last = corpus_pipeline.STAGES[-1][1](spark, was, sf)
    assert last.count() == kept


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Stored(stage(spark, docs, sf), "empty").df
    assert docs.count() == 0


def test_components_of_long_chains(spark):
    from cinderlake.llm.common import components

    random.seed(4)
    order = list(range(200))
    random.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}
