import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.llm import bpe, decontaminate, language, licenses, queries, quality, simhash, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ref string, key int, bucket string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "é", "x1", "Ünï"]


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 1, "b") for i, t in rows], DOCS)


def sentence(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "no id here at all, none"), (5, "tie"), (6, "tie"), (7, "same"), (7, "same"), (8, "x" * 5000)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_every_operator_takes_odd_rows(spark, rows):
    d = docs(spark, rows)
    bench = spark.createDataFrame([(0, None), (1, "too short"), (2, sentence(20))], "item_id long, text string")
    n = len(rows)
    assert bpe.encode_digests(d, queries.tokenizer_path()).count() == n
    assert simhash.near_duplicates(d).count() == n
    assert suffixes.dedup(d).count() == n
    assert language.identify(d, None).where("lang_pred = 'und'").count() == n
    tagger = language.train(["the of and", "der die das"], ["en", "de"])
    assert language.identify(d, tagger).where("id IN (1, 2, 3) AND lang_pred <> 'und'").count() == 0
    forest = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(d, forest).where("score BETWEEN 0 AND 1").count() == n
    assert decontaminate.contaminated(d, bench).count() == 0
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0
    assert licenses.scan(d).count() == 0
    for kept in (suffixes.remove_repeats(d), decontaminate.keep_clean(d, bench), simhash.keep_one(d), language.keep_identified(d, tagger, 0.0)):
        assert kept.columns == d.columns and kept.count() <= n


# BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    theirs, mine = Tokenizer.from_file(path), bpe.BpeCodec(path)
    r = random.Random(5)
    letters = [chr(i) for i in range(0x180)] + list("ΣσςİßẞǅﬁＡ中😀　 ́̈²Ⅰ١")
    texts = ["", " ", "ab" * 3000, "<|endoftext|>", "it's we'll <|startoftext|>x", "\U00011935\U00011930"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    # Every code point, between letters and marks that it may compose or change places with, or that may lower it by its place.
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(every[i : i + 1500]) for i in range(0, len(every), 1500)]
    texts += [" ".join(f.format(c) for c in every[i : i + 1500]) for f in ("aΣ{}", "A{}\u0316\u0301b", "e\u0345{}") for i in range(0, 0x20000, 1500)]
    r.shuffle(every)
    texts += ["".join(every[i : i + 400]) for i in range(0, 400_000, 400)]
    for t in texts:
        e, ids = theirs.encode(t, add_special_tokens=False), mine.encode(t)
        assert (bpe.count(ids), ids) == (len(e.ids), " ".join(map(str, e.ids)))
        assert mine.decode(ids) == theirs.decode(e.ids, skip_special_tokens=False)


def test_bpe_of_a_long_text_and_of_a_full_cache(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    theirs, mine = Tokenizer.from_file(path), bpe.BpeCodec(path)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    for t in [sentence(300_000, 1), "Aé" * 100_000]:
        assert mine.encode(t) == " ".join(map(str, theirs.encode(t, add_special_tokens=False).ids))


def test_segment_tree_takes_the_leftmost_lowest():
    tree = bpe.MinTree([5, 3, 9, 3])
    assert tree.node[1] == 3 and tree.update(1, 7) == 3 and tree.update(3, 8) == 5


# SimHash


def plain_fingerprint(text, width=4):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in [None, "", "one", "One TWO three four", sentence(50), "a\x0bb\x0cc\xa0d e\x1cf", "É " * 9]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("shard_rows", [50_000, 20])
def test_links_equal_brute_force(spark, shard_rows):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(6)} | {base[0] ^ (1 << k) for k in range(64)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = simhash.components(simhash.links(spark.createDataFrame(signed, "node long, fp long"), 4, shard_rows)).collect()
    root = simhash.forest(len(fps), iter([np.nonzero(np.array([[bin(a ^ b).count("1") <= 4 for b in fps] for a in fps]))]))
    want = {i: int(root[i]) for i in range(len(fps)) if (root == root[i]).sum() > 1}
    assert {x["node"]: x["component"] for x in got} == want


# Suffixes


def brute(rows, depth):
    owner = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for p in range(len(b) - depth + 1 if i is not None else 0):
            w = b[p : p + depth]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, b in coded:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - depth + 1 if i is not None else 0):
            if owner[b[p : p + depth]] < i:
                gone[p : p + depth] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("depth", "options"), [(50, {}), (50, {"group_bytes": 900, "hot_groups": 2}), (8, {"group_bytes": 900, "hot_groups": 2}), (3, {})])
def test_suffix_dedup_equals_brute_force(spark, depth, options):
    r = random.Random(depth)
    words = ["ab", "a", "b", "aaaa", "é", "xyz ", "lorem ipsum dolor "]
    rows = [(r.choice([None, *range(40)]), "".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(60)] + [(5, None), (7, "a" * 300), (8, "a" * 260), (3, "")]
    got = [(x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.dedup(docs(spark, rows).repartition(3), depth=depth, **options).collect()]
    assert sorted(got, key=str) == brute(rows, depth)


def test_repeats_of_one_row_are_dealt_out(spark):
    text = sentence(60, 2)
    rows = [(None, text)] * 40 + [(9, text)] * 40 + [(3, text), (4, "before " + text)]
    got = [(x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.dedup(docs(spark, rows), group_bytes=900).collect()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_windows_are_sorted_as_bytes_are():
    r = np.random.default_rng(4)
    raw = bytes(r.integers(97, 99, 3000).astype(np.uint8)) + bytes(8)
    word = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    start, who = np.arange(2900), r.integers(0, 9, 2900)
    for depth in (1, 7, 8, 20, 50):
        least = {}
        for s, w in zip(start.tolist(), who.tolist(), strict=True):
            least[raw[s : s + depth]] = min(w, least.get(raw[s : s + depth], w))
        got = suffixes.repeated_windows(word, start, who, depth).tolist()
        assert set(got) == {s for s in range(2900) if who[s] > least[raw[s : s + depth]]}
        assert [raw[s : s + depth] for s in got] == sorted(raw[s : s + depth] for s in got)


def test_kept_text_is_what_is_left(spark):
    passage = sentence(30, 3)
    rows = [(1, "start " + passage + " end"), (2, "other words " + passage + " of its own"), (3, passage)]
    left = {r["doc_id"]: r for r in suffixes.remove_repeats(docs(spark, rows)).collect()}
    assert left[1]["text"] == rows[0][1] and 3 not in left
    assert left[2]["text"].startswith("other words") and passage not in left[2]["text"] and left[2]["n_chars"] == len(left[2]["text"])


# Decontamination, licences


def test_decontamination_equals_oracle(spark, sf, same):
    same(queries.op2_benchmark_decontamination(spark, sf), queries.ORACLES["op2_benchmark_decontamination"])


def test_planted_passages_are_found_and_clean_ones_kept(spark):
    item = sentence(40, 9)
    words = item.split()
    near = " ".join(words[:20] + ["changed"] + words[21:])
    rows = [(1, sentence(200, 1)), (2, sentence(60, 2) + " " + item + ". " + sentence(60, 3)), (3, near), (4, item.upper()), (5, " ".join(words[:20]) + " " + sentence(100, 4)), (6, None)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r["id"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()} == {2, 3, 4}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs(spark, rows), bench).collect()} == {1, 5, 6}


def test_radius_keeps_pairs_at_the_least_similarity(spark):
    """Recall of the fingerprints on pairs of similarity 0.8 to 0.85, one of them with its changed shingles all equal."""
    r, rows = random.Random(3), []
    for k in range(3000):
        n = r.randint(10, 60)
        shared = -(-4 * n // 5)
        mine = [r.getrandbits(62) for _ in range(n)]
        other = mine[:shared] + ([r.getrandbits(62)] * (n - shared) if k % 2 else [r.getrandbits(62) for _ in range(n - shared)])
        rows.append((k, mine, other))
    df = spark.createDataFrame(rows, "item long, mine array<long>, other array<long>")
    side = lambda c: df.select("item", decontaminate.simhash(F.col(c)).alias("fp"), decontaminate.repeats(F.col(c)).alias("repeats"))
    for window, item in (("other", "mine"), ("mine", "other")):
        assert decontaminate.within_radius(side(window), side(item)).count() >= 0.9995 * len(rows)


def test_equal_items_and_clashing_names(spark):
    item = sentence(40, 9)
    bench = spark.createDataFrame([(0, item), (1, item.upper()), (2, sentence(40, 8))], "item_id long, text string")
    rows = docs(spark, [(1, "x " + item), (2, sentence(50, 1)), (None, item)]).withColumns({"gone": F.lit(1), "a.b": F.lit(2), "_": F.lit(3)})
    assert {(r["id"], r["item_id"]) for r in decontaminate.contaminated(rows, bench).collect()} == {(1, 0), (1, 1), (None, 0), (None, 1)}
    for kept in (decontaminate.keep_clean(rows, bench), simhash.keep_one(rows), suffixes.remove_repeats(rows)):
        assert kept.columns == rows.columns and kept.where("doc_id = 2").select("gone", "`a.b`", "_").first()[:] == (1, 2, 3)


def test_two_thirds_of_an_item_are_found(spark):
    sizes = (3, 6, 12)
    item = {n: [f"{w}{n}" for w in sentence(400, n).split()][: n + 4] for n in sizes}
    rows = [(n, " ".join(item[n][: 2 * n // 3 + 4])) for n in sizes] + [(100 + n, " ".join(item[n][: 2 * n // 3 + 3])) for n in sizes]
    bench = spark.createDataFrame([(n, " ".join(item[n])) for n in sizes], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r["id"], r["item_id"], r["similarity"]) for r in found} == {(n, n, 0.8) for n in sizes}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs(spark, rows), bench).collect()} == {100 + n for n in sizes}


def test_licences(spark, sf, same):
    same(queries.op1_license_scan(spark, sf), queries.ORACLES["op1_license_scan"])
    rows = [(1, "Some prose.\nLicensed under CC BY-NC 4.0."), (2, "licence talk: we are not licensed to say"), (3, "ALL RIGHTS RESERVED"), (4, licenses.TEMPLATES["MIT-grant"])]
    assert {(r["id"], r["licence"]) for r in licenses.scan(docs(spark, rows)).where("score = 1").collect()} == {(1, "CC-BY-NC-4.0"), (3, "All-rights-reserved"), (4, "MIT-grant")}


def test_licence_scan_lower_cases_a_text_once(spark):
    plan = licenses.scan(docs(spark, [(1, "Licensed under CC BY-NC 4.0.")]))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "merchantability" in line and "lower" in line]
    assert filters and all(line.count("lower(") == 1 for line in filters)


GRANT = licenses.TEMPLATES["MIT-grant"].split()
NOTICES = [
    ("This project is licensed under the MIT License.", {"MIT-notice"}), ("This software is released under the MIT License.", {"MIT"}), ("This work is licensed under CC BY 4.0.", {"CC-BY-4.0"}),
    ("Copyright 2024 Acme, all rights reserved.", {"All-rights-reserved"}), ("It may be\n * licensed under the\n * MIT License as a whole", {"MIT-notice"}), ("This project is licensed under CC BY-NC-ND 4.0.", {"CC-BY-NC-ND-4.0"}),
    ("\n".join("# " + " ".join(x) for x in [["Copyright", "2024", "Acme"], *(GRANT[i : i + 9] for i in range(0, len(GRANT), 9)), *(sentence(9, k).split() for k in range(20))]), {"MIT-grant"}),
    ("The project was licensed to us, all of it under the rights that the MIT licence reserved.", set()),
]


def test_notices_within_longer_units(spark):
    got = licenses.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])).collect()
    assert {(r["id"], r["licence"]) for r in got} == {(i, n) for i, (_, names) in enumerate(NOTICES) for n in names} and all(r["score"] >= 0.8 for r in got)


def test_whole_licence_texts_are_told_apart(spark):
    bsd = licenses.TEMPLATES["BSD-3-Clause-text"]
    rows = [(1, "Copyright 2020 A. Nother\n\n" + licenses.TEMPLATES["BSD-2-Clause-text"]), (2, "Copyright 2021 B\n" + bsd.replace(". ", ".\n * ")), (3, sentence(500, 4) + " " + licenses.TEMPLATES["MIT-text"] + " " + sentence(400, 5))]
    best = {}
    for r in licenses.scan(docs(spark, rows)).where("licence LIKE '%text'").collect():
        best[r["id"]] = max(best.get(r["id"], (0, "")), (r["score"], r["licence"]))
    assert {i: b[1] for i, b in best.items()} == {1: "BSD-2-Clause-text", 2: "BSD-3-Clause-text", 3: "MIT-text"}


def test_licence_sql_holds_windows_too(spark, duck, tmp_path):
    import duckdb

    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(50, sentence(90, 1) + " " + licenses.TEMPLATES["ISC-text"] + " " + sentence(90, 2)), (51, None)]
    path = str(tmp_path / "documents")
    docs(spark, rows).select("doc_id", "text").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    names = ["doc_id", "licence", "score", "n_units", "unit"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({licenses.oracle()})").fetchall()
    got = licenses.scan(spark.read.parquet(path)).withColumnRenamed("id", "doc_id").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 8


def test_windows_equal_brute_force(spark):
    r, rows = random.Random(7), []
    for i in range(150):
        w = [x for _ in range(r.randint(1, 3)) for x in sentence(r.randint(0, 12), r.random()).split() + licenses.plain_words(r.choice(list(licenses.NOTICES.values())))]
        rows.append((i, " ".join(x if r.random() > 0.06 else r.choice(["", "the", "other"]) for x in w)))
    want = set()
    for i, t in rows:
        w = licenses.plain_words(t)
        for name, text in licenses.TEMPLATES.items():
            known, k = set(licenses.plain_bigrams(text)), len(licenses.plain_words(text))
            hits = [p for p in range(len(w) - 1) if f"{w[p]} {w[p + 1]}" in known]
            for p in {min(p, len(w) - k) for p in hits} if len(w) >= k else ():
                have = set(licenses.plain_bigrams(" ".join(w[p : p + k])))
                score = 2 * len(have & known) / (len(have) + len(known))
                if score >= licenses.LEAST:
                    want.add((i, name, " ".join(w[p : p + k]), round(score, 6)))
    got = licenses.windows(docs(spark, rows).selectExpr("doc_id AS id", "text AS body"), licenses.TEMPLATES, licenses.LEAST).collect()
    assert {(x["id"], x["m"]["licence"], x["unit"], round(x["m"]["score"], 6)) for x in got} == want and len(want) > 100


def test_telling_words_prune_nothing():
    for text in licenses.TEMPLATES.values():
        grams = licenses.plain_bigrams(text)
        tell = licenses.telling_words(licenses.TEMPLATES, licenses.LEAST)
        untold = [b for b in grams if not any(t in b for t in tell)]
        assert len(untold) < licenses.LEAST / (2 - licenses.LEAST) * len(grams)


# Learned operators


def test_language_on_held_out_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.op3_language_id(spark, sf).join(rows, "doc_id").where("held_out AND n > 60").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    emit, step, start = r.random((1, 4, 3)), r.random((3, 3)), r.random(3)
    held = np.ones((1, 4), bool)
    p, moves, first, _ = language.marginals(emit, step, start, held)
    total, want, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        w = start[path[0]] * np.prod([emit[0, t, k] for t, k in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += w
        for t, k in enumerate(path):
            want[t, k] += w
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w
    assert np.allclose(p[0], want / total) and np.allclose(moves, pairs / total) and np.allclose(first[0], want[0] / total)


def test_code_switch_is_labelled_word_by_word():
    tagger = language.train(["the cat sat on the mat and the dog ran"] * 3 + ["der hund und die katze ist nicht auf dem dach"] * 3, ["en"] * 3 + ["de"] * 3)
    label = language.Labeller(tagger)
    assert label.label(["the cat and the dog"])[0][0] == "en" and label.label(["die katze und der hund"])[0][0] == "de"
    assert label.label(["the cat and the dog", "the cat and die katze"])[1][1] < label.label(["the cat and the dog"])[0][1]


def test_crowded_cache_gives_the_same_labels(monkeypatch):
    tagger = language.train([sentence(80, 1), "der hund " * 40], ["en", "de"])
    texts = [sentence(70, k) for k in range(4)] + ["der hund", None]
    want = language.Labeller(tagger).label(texts)
    monkeypatch.setattr(language, "CACHE_WORDS", 5)
    got = language.Labeller(tagger).label(texts)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op6_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.9


def test_flat_forest_scores_like_its_nodes():
    r = np.random.default_rng(1)
    x = r.random((400, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float)
    f = quality.fit_forest(x, y)

    def walk(row):
        total = f.base
        for n in f.roots:
            while f.below[n] != n:
                n = f.below[n] if row[f.statistic[n]] <= f.cut[n] else f.above[n]
            total += f.value[n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [walk(row) for row in x]) and ((f.score(x) > 0.5) == y).mean() > 0.95
