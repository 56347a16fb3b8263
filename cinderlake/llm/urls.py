"""URL filter: given host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: the labels of its host with their level, the words of its path with digits folded, file
ending, query keys, scheme. FP-growth over labelled URLs yields token combinations that imply ``block``; combinations
below the least support or confidence go, and so does a rule where one shorter by a token has at least its confidence,
as that one fires wherever it does. Tokens that are on exactly the same labelled URLs are one class, mined once: a rule
with one of them would have the same support and confidence with any other, so any of them hits it. Rules of any length
are matched by an inverted index from token to rule: a rule fires where all its classes were hit.

A null URL, or one without ``://``, has empty host and path, no token, no rule, and is allowed, as is a URL on which no
mined rule fires. Where several fire, ``mined`` names the one of highest confidence, ties by the name; a class is named by its first token. Repeated rows
get the same verdict each, so do repeated and null ids; long URLs are read whole; an empty table gives no rows, and
where nothing is labelled nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import broadcast_if_small, column

# The rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bounds of the mining: least support and confidence.
LEAST_SUPPORT, LEAST_CONFIDENCE = 0.02, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls where none does."""
    name = verdict = None
    for what, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, domain + start) if name is None else name.when(fits, domain + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL, sorted."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    labels = F.reverse(F.split(host, r"\."))
    domains = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x))
    steps = F.transform(F.filter(F.split(fold(path), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), fold(F.split(x, "=")[0])))
    kind = F.regexp_extract(path, r"\.(\w{1,6})$", 1)
    other = F.array(F.when(kind != "", F.concat(F.lit("ending:"), F.lower(kind))), F.when(url.contains("#"), F.lit("fragment")), F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    found = F.array_sort(F.array_distinct(F.concat(F.filter(domains, lambda x: ~x.endswith(":")), steps, keys, F.array_compact(other))))
    return F.when(F.coalesce(host, F.lit("")) != "", found).otherwise(F.array().cast("array<string>"))


def token_classes(labelled: DataFrame, support: float) -> dict[str, str]:
    """The frequent tokens, each with the first token that is on exactly the same rows.

    Each is on ``support`` of all rows, so there are at most the mean number of tokens of a URL, divided by ``support``.
    Equal rows are told by their number and the sum of their hashes.
    """
    rows = labelled.select(F.explode("items").alias("token"), F.xxhash64("items", F.lit(3)).cast("decimal(38,0)").alias("hash"))
    sums = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("hash").alias("hash")).where(F.col("n") >= support * labelled.count())
    first: dict[tuple, str] = {}
    return {r["token"]: first.setdefault((r["n"], r["hash"]), r["token"]) for r in sorted(sums.collect(), key=lambda r: r["token"])}


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> tuple[DataFrame, dict[str, str]]:
    """``(items, confidence)``: classes that imply ``block``, from ``labelled(items array<string>, verdict string)``; and the class of each token.

    All labelled URLs are mined, repeats counted. The support is that of the tokens together with ``block``.
    """
    classes = token_classes(labelled, support)
    marked = F.concat(F.array_intersect("items", F.array(*map(F.lit, sorted(set(classes.values())))).cast("array<string>")), F.array(F.concat(F.lit("="), "verdict")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(marked.alias("items")))
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit("=block"))) & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence")
    shorter = rules.select("items", "confidence", F.explode("items").alias("out")).select("items", "confidence", F.array_remove("items", F.col("out")).alias("part"))
    covered = shorter.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure")), "part").where("sure >= confidence").select("items")
    return rules.join(covered, "items", "left_anti"), classes


def fired(sets: DataFrame, rules: DataFrame, classes: dict[str, str]) -> DataFrame:
    """``(items, mined)``: the token sets that hit all classes of a rule, and that rule, by an inverted index from token to rule."""
    alike = sets.sparkSession.createDataFrame(sorted(classes.items()), "token string, class string")
    named = rules.select(F.array_join("items", " & ").alias("name"), "items", "confidence")
    index = named.select(F.explode("items").alias("class"), "name", "confidence", F.size("items").alias("size"))
    hit = sets.select("items", F.explode("items").alias("token")).join(broadcast_if_small(alike), "token").select("items", "class").distinct()
    hits = hit.join(broadcast_if_small(index), "class")
    whole = hits.groupBy("items", "name", "confidence", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.groupBy("items").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "name")).alias("best")).select("items", F.col("best.name").alias("mined"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, mined)`` per row of ``pages``.

    ``labels`` (url, verdict) are the URLs to learn from. Without them those of the pages that a given rule fits are,
    with its verdict; they alone, as nobody has judged the others. ``mined`` is the mined rule that blocks, where no
    given rule fits.
    """
    rows = pages.select(column(pages, id_col).cast("long").alias("id"), column(pages, url_col).cast("string").alias("url"))
    shaped = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = shaped.select("id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    if labels is None:
        labelled = ruled.select("items", F.col("ruled").alias("verdict"))
    else:
        host, path = host_of(labels["url"]), path_of(labels["url"])
        labelled = labels.select(tokens(labels["url"], host, path).alias("items"), "verdict")
    labelled = labelled.where("verdict IS NOT NULL AND size(items) > 0")
    out = ruled.withColumn("mined", F.lit(None).cast("string"))
    if not labelled.isEmpty():
        # Token sets repeat: each is matched once.
        bad = fired(ruled.where("ruled IS NULL").select("items").distinct(), *mine(labelled))
        out = ruled.join(broadcast_if_small(bad), "items", "left")
    mined = F.when(F.col("ruled").isNull(), F.col("mined"))
    method = F.when(mined.isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), mined.alias("mined"))
