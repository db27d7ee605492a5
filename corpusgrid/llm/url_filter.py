"""URL filter: given rules first, then association rules mined from labelled pages.

A URL's tokens are its scheme, host, last two host labels, host labels and their words, words of the path (numbers stand as one token), names of query
parameters and fragment. Pages whose label says low quality or toxic are bad. Spark's FP-growth mines combinations of tokens together with that mark, from all frequent tokens of every labelled page. Tokens that
stand in the same labelled pages go in as one and are told apart again in the rules, and a token of all pages makes no combination surer, so neither is mined with the others: nothing is lost by that. A combination is a rule if enough
pages have it (support), enough of these are bad (confidence), and no combination with one token less is as sure. Where a page has more than `items` tokens that differ in their pages, its combinations
are too many for FP-growth, most of them with the same pages as one of their parts; then combinations grow level by level, and only those that each token makes smaller are grown. Both give the same rules.

Rules are matched by an inverted index: a rule stands under its rarest token, URLs meet it there, and all its tokens are looked up in the URL's. Everything is DataFrame
operations; the index is broadcast only below a counted size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import partitions, read, salted_join
from corpusgrid.session import materialise

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, ITEMS = 0.0005, 20, 0.6, 16
SMALL = 50_000  # rules or tokens that are broadcast
BAD = "bad"  # tokens have a colon, the mark has none


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z in lower case) and path of the contract; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, null if none fits. Equally long ones: the longer host, then block. For lists that fit into an expression."""
    found = []
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(len(rule_host)).alias("host"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,host:int,verdict:string,rule:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL."""

    def kind(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(mark), v))

    labels = F.split(host, r"\.")
    rest = F.when(F.instr(url, "://") > 0, url).otherwise(F.lit(""))
    query = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    parts = [
        kind("scheme:", F.array(F.lower(F.regexp_extract(rest, r"^([^:/?#]*)://", 1)))), kind("host:", F.array(host)), kind("domain:", F.array(F.substring_index(host, ".", -2))), kind("label:", labels),
        kind("word:", F.split(host, r"[^a-z]+")), kind("path:", F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda p: F.regexp_replace(p, r"^\p{N}+$", "0"))),
        kind("query:", F.transform(query, lambda q: F.substring_index(q, "=", 1))), kind("fragment:", F.array(F.regexp_extract(rest, r"#(.*)$", 1))),
    ]
    return F.array_distinct(F.concat(*parts))


def combined(baskets: DataFrame, least: float, n_partitions: int) -> DataFrame:
    """items, n, hits (bad ones among the n baskets that have all items): all combinations with `least` hits, by FP-growth."""
    marked = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    support = (math.ceil(least) - 0.5) / baskets.count()  # between two whole numbers of baskets, whatever the rounding
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, support), numPartitions=n_partitions).fit(marked).freqItemsets
    sets = materialise(sets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    hits = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    return hits.join(sets.select("items", F.col("freq").alias("n")).hint("merge"), "items").select("items", "n", "hits")


def grown(baskets: DataFrame, least: float) -> DataFrame:
    """The same without combinations that have as many baskets as one of their parts, or a part whose baskets are all bad; level by level."""
    rows = materialise(baskets.withColumn("id", F.monotonically_increasing_id()), "url-rows")
    each = rows.select("id", "bad", F.explode("items").alias("token"))
    now, out, last = each.select("id", "bad", F.array("token").alias("items")), None, None
    while True:
        now = materialise(now, "url-grown")
        sets = now.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits")).where(F.col("hits") >= least)
        if last is not None:
            parts = sets.select("items", "n", F.explode("items").alias("without")).select("items", "n", F.array_remove("items", F.col("without")).alias("part"))
            larger = parts.join(last.select(F.col("items").alias("part"), F.col("n").alias("of")), "part").where("of > n").groupBy("items").agg(F.count(F.lit(1)).alias("parts"))
            sets = sets.join(larger.where(F.col("parts") == F.size("items")).select("items"), "items")
        sets = materialise(sets, "url-level")
        if sets.isEmpty():
            return sets if out is None else out
        out, last = sets if out is None else out.unionByName(sets), sets.where("hits < n")
        going = salted_join(now, last.select("items"), ["items"]).select("id", "bad", "items")
        now = going.join(each.select("id", "token"), "id").where(F.col("token") > F.element_at("items", -1)).select("id", "bad", F.array_append("items", F.col("token")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, items: int = ITEMS) -> DataFrame | None:
    """rule (sorted tokens), key (its rarest token), n (labelled pages that have them), confidence; None where no page is bad or none is labelled. `labelled`: id, tokens, bad (boolean).

    `items`: the most tokens of a page that FP-growth is given; it chooses the way, not the result.
    """
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return None
    least = max(min_count, min_support * total["n"])
    each = labelled.select("id", "bad", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(name) for i, name in enumerate(("one", "two"))]  # 128 bits that stand for a token's pages
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"), *where).where(F.col("hits") >= least)
    often = materialise(often, "url-tokens")
    alike = often.groupBy("n", "hits", "one", "two").agg(F.min("token").alias("token"), F.collect_list("token").alias("tokens"))
    alike = materialise(alike.select("token", "n", "hits", "tokens"), "url-alike")
    told = alike.where(F.col("n") < total["n"]).select("token")
    # at most (tokens of a URL) / min_support tokens are frequent
    told = each.join(F.broadcast(told), "token") if often.count() <= SMALL else salted_join(materialise(each, "url-each"), told, ["token"])
    baskets = materialise(told.groupBy("id", "bad").agg(F.array_sort(F.collect_list("token")).alias("items")).select("bad", "items"), "url-baskets")
    sets = alike.where(F.col("n") == total["n"]).select(F.array("token").alias("items"), "n", "hits")
    if (widest := baskets.agg(F.max(F.size("items"))).first()[0]) is not None:
        sets = sets.unionByName(combined(baskets, least, partitions(labelled)) if widest <= items else grown(baskets, least))
    rules = sets.where(F.col("hits") >= least).select(F.col("items").alias("rule"), "n", (F.col("hits") / F.col("n")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    rules = materialise(rules, "url-rules")
    smaller = rules.select("rule", "confidence", F.explode("rule").alias("without")).select("rule", "confidence", F.array_remove("rule", F.col("without")).alias("part"))
    sure = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("sure"))
    idle = smaller.join(sure, "part").where("sure >= confidence").select("rule").distinct()
    rules = materialise(rules.join(idle, "rule", "left_anti"), "url-pruned")
    # each token that stands for several gives way to each of them
    members = rules.select("rule", F.explode("rule").alias("token")).join(alike.select("token", "tokens"), "token").groupBy("rule").agg(F.collect_list("tokens").alias("members"))
    chosen = F.reduce("members", F.array(F.array().cast("array<string>")), lambda made, tokens: F.flatten(F.transform(made, lambda m: F.transform(tokens, lambda x: F.array_append(m, x)))))
    rules = rules.join(members, "rule").select(F.explode(chosen).alias("rule"), "n", "confidence").withColumn("rule", F.array_sort("rule"))
    rules = materialise(rules, "url-told-apart")
    rarest = rules.select("rule", F.explode("rule").alias("token")).join(often.select("token", F.col("n").alias("seen")), "token").groupBy("rule").agg(F.min(F.struct("seen", "token")).alias("key"))
    return rules.join(rarest, "rule").select("rule", F.col("key.token").alias("key"), "n", "confidence")


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """id, best (confidence, n, rule): the surest rule of each row that has all tokens of one. `rows`: id, tokens."""
    index = materialise(rules.groupBy("key").agg(F.collect_list(F.struct("confidence", "n", "rule")).alias("rules"), F.count(F.lit(1)).alias("size")), "url-index")
    each = rows.select("id", "tokens", F.explode("tokens").alias("key"))
    small = (index.agg(F.sum("size").alias("n")).first()["n"] or 0) <= SMALL
    met = each.join(F.broadcast(index), "key") if small else salted_join(materialise(each, "url-keys"), index, ["key"])
    has_all = F.filter("rules", lambda r: F.size(F.array_except(r["rule"], F.col("tokens"))) == 0)
    return met.select("id", F.array_max(has_all).alias("best")).where("best is not null").groupBy("id").agg(F.max("best").alias("best"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (tokens of the mined rule), confidence: a row for each row of `pages`.

    A given rule decides where one fits. Else the page is blocked if a mined rule matches, and allowed if none does. Labels (quality, toxic) belong to the page of their id; a page is bad if any of its labels says quality 0 or toxic 1, and labels with
    neither value, and pages or labels without an id, teach nothing. A null URL, or one without `://`, has no host, path or tokens. Repeated rows come back as often as they stand; other columns are not
    looked at. Without bad labels everything that no rule blocks is allowed; nothing comes of an empty table. `limits`: as of `mine`.
    """
    url = F.col("url")
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(url)
    known = known.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = known.select("page_id", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("given"), tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    known = materialise(known.withColumn("id", F.monotonically_increasing_id()), "url-pages")
    marks = labels.where("quality is not null or toxic is not null").select(F.col(label_id).cast("long").alias("page_id"), F.expr("coalesce(quality = 0, false) or coalesce(toxic = 1, false)").alias("bad")).where("page_id is not null")
    marks = marks.groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    labelled = salted_join(known.where("page_id is not null").select("page_id", "id", "tokens"), materialise(marks, "url-marks").hint("merge"), ["page_id"]).select("id", "tokens", "bad")
    mined = mine(materialise(labelled, "url-labelled"), **limits)
    none = "struct<confidence:double,n:bigint,rule:array<string>>"
    if mined is None:
        judged = known.withColumn("best", F.lit(None).cast(none))
    else:
        judged = known.join(match(known.where("given is null").select("id", "tokens"), materialise(mined, "url-mined")), "id", "left")
    verdict = F.coalesce("given.verdict", F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.col("best.rule").alias("mined"), F.col("best.confidence").alias("confidence"))


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")
