"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed n-grams (words and pairs of neighbouring words) are counted: the trusted target (documents
labelled good) and the raw corpus (every document). A document's score is the mean over its n-grams of
log p_target - log p_raw, so it does not depend on length, and one fixed threshold decides every document.
No text is shuffled: n-grams are counted in the map tasks, and only a row per bucket and task moves. The ratios
are a table of one array of `buckets` doubles, whose size is fixed by the parameter, and the scores read it as a scalar subquery: so
no plan, and no description of one that the driver makes and keeps, spells them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import SPACE, read
from corpusgrid.session import materialise

BUCKETS, THRESHOLD, TRUSTED_ROWS, PRIOR, GRAMS = 1 << 18, -0.2, 50_000, 4.0, 2
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
PLACE_BITS, HASH_BITS = 24, 40


def words(text: Column) -> Column:
    """What common.words gives. White space at both ends is trimmed first, so that no lambda has to look at every word for empty ones."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE))


def with_places(docs: DataFrame, hash_bits: int = HASH_BITS, place_bits: int = PLACE_BITS) -> DataFrame:
    """`docs`, which has the array __words, with __places: places of the three-word windows that are found twice or more, in order.

    Each window becomes one long, the low bits of its hash above its place, so that after sorting windows of equal hash are neighbours. If two
    neighbours of equal hash have other words, or the text has more words than places, its windows are sorted by their words instead.
    Each step is a column of its own, as a lambda works out what it mentions anew for each element.
    """
    ws, n = F.col("__words"), F.size("__words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    mask = F.lit((1 << hash_bits) - 1)
    code = lambda i: F.shiftleft(F.xxhash64(*(F.get(ws, i + k) for k in range(3))).bitwiseAND(mask), place_bits).bitwiseOR(i.cast("long"))
    place = lambda x: x.bitwiseAND(F.lit((1 << place_bits) - 1)).cast("int")

    def equal(x: Column, y: Column) -> Column:
        """1: equal windows, 2: equal hashes of other words, 0: neither."""
        words = F.lit(True)
        for k in range(3):
            words = words & F.get(ws, place(x) + k).eqNullSafe(F.get(ws, place(y) + k))
        return F.when(F.coalesce(F.shiftright(x, place_bits) == F.shiftright(y, place_bits), F.lit(False)), F.when(words, 1).otherwise(2)).otherwise(0)

    def beside(flags: str):
        """Whether a window equals the next one or the one before."""
        return lambda _, i: (F.get(flags, i) == 1) | (F.coalesce(F.get(flags, i - 1), F.lit(0)) == 1)

    docs = docs.withColumn("__coded", F.sort_array(F.transform(starts, code)))
    docs = docs.withColumn("__flags", F.transform("__coded", lambda x, i: equal(x, F.get("__coded", i + 1))))
    unsure = F.array_contains("__flags", 2) | (n > (1 << place_bits))
    whole = F.sort_array(F.transform(starts, lambda i: F.struct(*(F.get(ws, i + k).alias(f"w{k}") for k in range(3)), i.alias("i"))))
    docs = docs.withColumn("__whole", F.when(unsure, whole))
    same = lambda x, y: F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))
    docs = docs.withColumn("__same", F.transform("__whole", lambda x, i: same(x, F.get("__whole", i + 1)).cast("int")))
    slow = F.transform(F.filter("__whole", beside("__same")), lambda x: x["i"])
    fast = F.when(F.array_contains("__flags", 1), F.transform(F.filter("__coded", beside("__flags")), place)).otherwise(F.array().cast("array<int>"))
    places = F.sort_array(F.when(F.col("__whole").isNotNull(), slow).otherwise(fast))
    return docs.withColumn("__places", places).drop("__coded", "__flags", "__whole", "__same")


def with_base(docs: DataFrame, text_col: str = "text", hash_bits: int = HASH_BITS, place_bits: int = PLACE_BITS) -> DataFrame:
    """`docs` with the base columns and the array __words. Null text has no words, lines or symbols.

    n_repeat_words: the places of repeated windows, in order, cover three words each, less what the one before covers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = with_places(docs.withColumn("__words", words(text)), hash_bits, place_bits)
    n = F.size("__words")
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda column: F.length(column).cast("long")
    docs = docs.withColumns({
        "n_words": n.cast("long"),
        "word_chars": size(F.array_join("__words", "")),
        "n_symbols": size(text) - size(F.regexp_replace(text, r"[#*$%&|<>]", "")),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop("__places")


def grams(ws: Column, buckets: int, n: int = GRAMS) -> Column:
    """The bucket of each n-gram of 1 to n words, as an array."""

    def of(k: int) -> Column:
        heads = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0))) if k > 1 else ws
        return F.transform(heads, lambda w, i: F.pmod(F.xxhash64(w, *(F.get(ws, i + j) for j in range(1, k))), F.lit(buckets)).cast("int"))

    return F.concat(*(of(k) for k in range(1, n + 1)))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most `rows` ids of documents labelled good and not toxic: those of the smallest hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", n: int = GRAMS) -> DataFrame:
    """One row, one array column: log p_target - log p_raw by bucket.

    Both rates get `prior` added on the scale of the target's counts, so that a bucket seen a few times only
    says little and the scores keep their scale from small corpora to large ones.

    `trusted` is what trusted_ids returns, so its size is bounded and it is broadcast. The raw counts cover all rows.
    Without trusted rows every ratio is 0.
    """
    marked = docs.select(F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__w")).join(
        F.broadcast(trusted.withColumn("__t", F.lit(1))), "__id", "left"
    )
    counts = marked.select("__t", F.explode(grams(F.col("__w"), buckets, n)).alias("b")).groupBy("b")
    counts = counts.agg(F.count("__t").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["t", "r"])
    row = every.agg(F.collect_list(F.struct("b", "t", "r")).alias("v"), F.sum("t").alias("t"), F.sum("r").alias("r"))
    ratio = lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.log(x["t"] + prior) - F.log(x["r"] * F.col("t") / F.col("r") + prior))
    return row.select(F.transform(F.array_sort("v"), ratio).alias("ratios"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", n: int = GRAMS) -> DataFrame:
    """`docs` with the base columns, llr_score and kept, for every row.

    Null or empty text: no words, base_failed, score 0. Repeated rows each get the same result. Without
    usable labels all scores are 0 and the base rules alone decide. Input columns of these names are replaced.
    The call runs the counting job and writes its `buckets` doubles to the shared folder.
    """
    docs = docs.drop(*(c for c in docs.columns if c in (*BASE, "llr_score", "kept")))
    ratios = log_ratios(docs, trusted_ids(labels), buckets, prior, id_col, text_col, n)
    ratios = materialise(ratios.select(F.transform("ratios", lambda x: F.round(x, 9)).alias("ratios")), "log-ratios")
    # __ratios and __grams are each used once: so the optimizer works them into the sum, and no row carries an array of all ratios.
    scored = with_base(docs, text_col).withColumns({"__grams": grams(F.col("__words"), buckets, n), "__ratios": ratios.scalar()})
    total = F.aggregate("__grams", F.lit(0.0), lambda acc, b: acc + F.get("__ratios", b))
    number = sum((F.greatest(F.size("__words") - k, F.lit(0)) for k in range(n)), F.lit(0))
    scored = scored.withColumn("llr_score", F.round(F.when(number > 0, total / number).otherwise(0.0), 9))
    # A filter on `kept` must not move below the projections: there it would work out the windows of a text anew for each of its words.
    # The second condition always holds, but is not deterministic to the optimizer, which then leaves the filter where it is.
    kept = ~F.col("base_failed") & (F.col("llr_score") >= threshold) & (F.monotonically_increasing_id() >= 0)
    return scored.withColumn("kept", kept).drop("__words", "__grams", "__ratios")


def query(spark, sf_dir: str) -> DataFrame:
    docs = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.select("doc_id", *BASE, "llr_score", "kept")
