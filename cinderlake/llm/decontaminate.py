"""Benchmark decontamination, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. For each benchmark item of W words the
windows of W words of a document are candidates. A window can only reach the similarity if enough of its shingles
belong to the item, and the best window starts at such a shingle, so windows are laid at these starts alone: nothing
that could pass is left out. Each window gets a 64-bit SimHash over its shingles, repeats counted. A multi-index over
8 blocks of 8 bits holds each item under all values that differ in at most 3 bits from its own block; two fingerprints
within ``RADIUS`` bits (8 x 3 + 7) then meet in at least one block. A window asks for the items alone whose shingles
led to it. Pairs within the radius are verified by the exact similarity of the shingle multisets, 2 * shared /
(window + item), which must reach ``LEAST``.

At a similarity of 0.8 about a fifth of the bits differ, 12.3 with a deviation of 3.2 as measured, so the radius of 31
lets next to nothing go. Where a shingle repeats in a window or an item its votes fall together and more bits differ:
such pairs go to the exact check whatever their fingerprints. A test measures the recall.

Null texts hold no words. Items of fewer than five words have no shingle and match nothing. Items with equal words are
compared once. A document shorter than the item is one window. Equal rows give one result; an id with several texts
gives one row per item, the best; rows without an id are one document. Of windows with equal similarity the first is
given. Texts are read whole, however long. Empty tables give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Stored, broadcast_if_small, column, fresh_name

WIDTH, LEAST = 5, 0.8
#: Largest Hamming distance between the fingerprints of a window and an item: blocks, bits of a block and differing bits that cover it.
RADIUS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 31, 8, 8, 3

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """One hash for each run of ``width`` words; fewer words: none."""
    each = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))
    return F.slice(each, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))


def simhash(hashes: Column) -> Column:
    """Bit b is set if over half of the hashes have it. Bits k and k + 32 are counted at once in the halves of a long.

    Written as folds over arrays: as one expression for each bit the generated code grows so large that compiling it
    takes the executor gigabytes.
    """
    halves = F.lit((1 << 32) | 1)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(halves)))

    def bit(lane: Column, k: Column) -> Column:
        one = F.lit(1).cast("long")
        low = F.when(2 * lane.bitwiseAND(F.lit((1 << 32) - 1)) > F.size(hashes), F.call_function("shiftleft", one, k)).otherwise(F.lit(0).cast("long"))
        high = F.when(2 * F.shiftrightunsigned(lane, 32) > F.size(hashes), F.call_function("shiftleft", one, k + 32)).otherwise(F.lit(0).cast("long"))
        return low.bitwiseOR(high)

    return F.aggregate(F.transform(lanes, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds ``fp`` from the column ``hashes``. It cannot be null: else Spark would test that first, by working it out once more."""
    return df.withColumn("fp", F.coalesce(simhash(F.col("hashes")), F.lit(0).cast("long")))


def block_values(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for i in range(BLOCKS)))


def near_values(blocks: Column) -> Column:
    """All block values within ``BLOCK_RADIUS`` bits of the given ones."""
    flips = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
    masks = F.array(*(F.lit(m).cast("long") for m in flips))
    return F.flatten(F.transform(blocks, lambda b: F.transform(masks, lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))


def shared_weight(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets given as arrays."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def shingle_texts(w: Column, width: int = WIDTH) -> Column:
    each = F.transform(w, lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, width)))
    return F.slice(each, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))


def candidates(rows: DataFrame, items: DataFrame, sizes: list[int], least: float) -> Stored:
    """The ``rows`` that can hold an item: those with an item's shingle at one of every ``step`` places.

    A window that passes misses at most ``n - ceil(least * n)`` of its n shingles, so if more places than that are
    looked at in any n, one of them has a shingle of the item. ``step`` is the largest that ensures this for all item
    sizes. In documents shorter than the longest item, whose windows are shorter, every place is looked at.
    """
    fits = lambda step: all(n // step > n - math.ceil(least * n - 1e-9) for n in sizes)
    step = max((k for k in range(1, 17) if fits(k)), default=1)
    longest = max(sizes, default=0) + WIDTH - 1
    split = rows.select("ref", words(F.col("body")).alias("words"))
    places = F.sequence(F.lit(0), F.size("words") - WIDTH, F.when(F.size("words") < longest, 1).otherwise(step))
    some = F.transform(places, lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WIDTH))))
    asked = split.where(F.size("words") >= WIDTH).select("ref", F.explode(some).alias("hash"))
    known = broadcast_if_small(items.select(F.explode("hashes").alias("hash")).distinct())
    hits = Stored(asked.join(known, "hash", "left_semi").select("ref").distinct(), "hits")
    held = Stored(rows.join(broadcast_if_small(hits.df), "ref", "left_semi"), "candidates")
    hits.drop()
    return held


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(ref, id, item_id, similarity, start_word)``: the best window of each document for each item it holds.

    ``ref`` hashes id and text, and stands for the row.
    """
    texts = benchmark.select(column(benchmark, item_col).alias("item_id"), words(column(benchmark, item_text_col).cast("string")).alias("item_words")).where(F.size("item_words") >= WIDTH)
    named = Stored(texts.select("item_id", "item_words", F.xxhash64("item_words").alias("item")).distinct(), "items")
    items = with_fingerprint(named.df.select("item", "item_words").dropDuplicates(["item"]).withColumn("hashes", shingle_hashes(F.col("item_words"))))
    table = Stored(items.select("item", "item_words", "hashes", F.size("hashes").alias("n"), "fp", repeats(F.col("hashes")).alias("repeats")), "benchmark")
    items = table.df

    id_, text = column(docs, id_col).cast("long"), column(docs, text_col).cast("string")
    rows = docs.select(F.xxhash64(id_, text).alias("ref"), id_.alias("id"), text.alias("body"))
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # of different lengths, not of items
    held = candidates(rows, items, sizes, least)
    split = held.df.select("ref", "id", words(F.col("body")).alias("words"))
    known = broadcast_if_small(items.select("item", "n", F.explode(F.array_distinct("hashes")).alias("hash")))
    found = split.select("ref", F.size("words").alias("size"), F.posexplode(shingle_hashes(F.col("words"))).alias("pos", "hash")).join(known, "hash")

    # Starts from which enough of the item's shingles lie in a window; at the end of a document the window slides back.
    # The quotients can lie just above a whole number, as 8.000000000000002 for n = 12.
    need = F.ceil(least * F.col("n") / (2 - least) - 1e-9).cast("int")  # shared >= least * (window + n) / 2 and window >= shared
    full = F.ceil(least * F.col("n") - 1e-9).cast("int")
    span = F.least(F.col("n"), F.col("size") - (WIDTH - 1))  # shingles of a window
    least_shared = F.when(span == F.col("n"), full).otherwise(need)
    places = found.groupBy("ref", "item", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    places = places.withColumn("span", span).withColumn("need", least_shared).where(F.size("at") >= F.col("need"))
    dense = F.filter("at", lambda p, i: F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("span"))
    slid = F.array_distinct(F.transform(dense, lambda p: F.least(p, F.col("size") - (WIDTH - 1) - F.col("span"))))
    # A window is laid once for all the items that led to it.
    laid = places.select("ref", "item", "n", "span", F.explode(slid).alias("start")).groupBy("ref", "n", "span", "start").agg(F.collect_set("item").alias("asks"))
    starts = Stored(laid.groupBy("ref").agg(F.collect_list(F.struct("n", "span", "start", "asks")).alias("windows")), "windows")

    cut = split.join(broadcast_if_small(starts.df), "ref").select("ref", "id", "words", F.explode("windows").alias("w")).select(
        "ref", "id", "w.start", "w.asks", F.slice("words", F.col("w.start") + 1, F.col("w.span") + (WIDTH - 1)).alias("words")
    )
    marked = with_fingerprint(cut.withColumn("hashes", shingle_hashes(F.col("words"))))
    asked = marked.select("ref", "id", "start", "fp", repeats(F.col("hashes")).alias("repeats"), "words", F.explode("asks").alias("item"))
    near = within_radius(asked, items)
    pairs = near.join(broadcast_if_small(items.select("item", "item_words")), "item")
    texts = pairs.withColumn("a", shingle_texts(F.col("words"))).withColumn("b", shingle_texts(F.col("item_words")))
    similarity = 2.0 * shared_weight(F.col("a"), F.col("b")) / (F.size("a") + F.size("b"))
    # The bound on the similarity is put behind the grouping: before it, Spark would work the similarity out twice.
    best = texts.select("ref", "id", "item", F.round(similarity, 6).alias("similarity"), "start").groupBy("ref", "id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"))).alias("best"))
    passed = best.select("ref", "id", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).cast("long").alias("start_word")).where(F.col("similarity") >= least)
    out = Stored(passed.join(broadcast_if_small(named.df.select("item", "item_id")), "item").select("ref", "id", "item_id", "similarity", "start_word"), "contaminated")
    for used in (starts, held, table, named):
        used.drop()
    return out.df


def repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def within_radius(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Those of ``asked(item, fp, repeats, ...)`` whose fingerprint lies within ``RADIUS`` bits of their item's, by the multi-index.

    Besides its blocks the index has a block -1, by which all pairs meet where the window (value 1) or the item (value
    0) repeats a shingle.
    """
    always = lambda *values: F.array(*(F.struct(F.lit(-1).alias("block"), F.lit(v).cast("long").alias("value")) for v in values))
    near = F.when(F.col("repeats"), always(0, 1)).otherwise(F.concat(near_values(block_values(F.col("fp"))), always(1)))
    index = items.select("item", F.col("fp").alias("item_fp"), F.explode(near).alias("b")).select("item", "item_fp", "b.block", "b.value")
    own = F.when(F.col("repeats"), always(1)).otherwise(F.concat(block_values(F.col("fp")), always(0)))
    probes = asked.select("*", F.explode(own).alias("b")).select(*asked.columns, "b.block", "b.value")
    met = probes.join(broadcast_if_small(index, 200_000), ["item", "block", "value"])
    # A pair that meets in several blocks is taken in the first of them.
    nearness = lambda i: F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
    first = F.coalesce(*(F.when(nearness(i) <= BLOCK_RADIUS, F.lit(i)) for i in range(BLOCKS)))
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.col("block") == first)
    return met.where((F.col("block") == -1) | close).select(*asked.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(id, item_id, similarity, start_word)``, one row per document id and item."""
    found = matches(docs, benchmark, **options)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("minus"))).alias("best"))
    return best.select("id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).alias("start_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    name = fresh_name(docs, "gone")
    gone = matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("ref").alias(name)).distinct()
    ref = F.xxhash64(column(docs, id_col).cast("long"), column(docs, text_col).cast("string"))
    return docs.join(broadcast_if_small(gone), ref == gone[name], "left_anti")


#: The same result in DuckDB SQL, without fingerprints: all windows that start at a shared shingle.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, len(w) AS size, p, array_to_string(w[p + 1 : p + 5], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
), sh AS (
  SELECT item_id, n, shingle, count(*) AS times
  FROM (SELECT item_id, len(w) - 4 AS n, array_to_string(w[p + 1 : p + 5], ' ') AS shingle
        FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM i WHERE len(w) >= 5))
  GROUP BY ALL
), hit AS (
  SELECT doc_id, size, p, item_id, n, shingle, times, least(n, size - 4) AS span FROM ds JOIN sh USING (shingle)
), st AS (
  SELECT DISTINCT doc_id, item_id, n, span, least(p, size - 4 - span) AS start FROM hit
), part AS (
  SELECT s.doc_id, s.item_id, s.n, s.span, s.start, h.shingle, least(count(*), any_value(h.times)) AS shared
  FROM st s JOIN hit h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.p >= s.start AND h.p < s.start + s.span
  GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, start, round(2.0::DOUBLE * sum(shared)::DOUBLE / (n + span), 6) AS similarity
  FROM part GROUP BY doc_id, item_id, n, span, start
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM sim WHERE similarity >= 0.8
)
SELECT doc_id, item_id, similarity, start::BIGINT AS start_word FROM best WHERE k = 1
"""
