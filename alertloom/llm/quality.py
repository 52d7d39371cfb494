"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word n-grams are hashed to buckets. Two multinomials over the buckets are counted, one from the trusted
documents, one from all; a document's score is the mean over its n-grams of the logarithm of their
ratio, and it is kept if the score reaches a threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import let, words

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14


def _shift(name: str, x: Column, bits: Column) -> Column:
    return F.call_function(f"shift{name}", x, bits)


def _repeat_words(w: Column, n: Column, bits: Column) -> Column:
    """Number of words in 3-word windows that stand twice or more among the words ``w``."""
    # Hash of each window with its place in the low bits, sorted: equal windows are neighbours.
    mark = lambda i: _shift("left", _shift("right", F.xxhash64(*[F.get(w, i + k) for k in range(3)]), bits), bits).bitwiseOR(i.cast("long"))
    at = lambda x: x.bitwiseAND(_shift("left", F.lit(1).cast("long"), bits) - 1).cast("int")
    equal = lambda x, y: F.coalesce((_shift("right", x, bits) == _shift("right", y, bits)) & (F.get(w, at(x)) == F.get(w, at(y))) & (
        F.get(w, at(x) + 1) == F.get(w, at(y) + 1)) & (F.get(w, at(x) + 2) == F.get(w, at(y) + 2)), F.lit(False))
    again = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))), at))
    # Words covered by windows of 3 that begin at the places ``p``.
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), mark))
    return F.when(n >= 3, let(windows, lambda s: let(again(s), covered))).otherwise(F.lit(0)).cast("long")


def base_rules(docs: DataFrame, text_col: str = "text", word_col: str = "_words") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row.

    ``word_col`` holds the words of the text, as ``common.words`` gives them; NULL texts have none.
    """
    text, w = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(word_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    bits = lambda w: F.ceil(F.log2(F.greatest(F.size(w), F.lit(2)) + 1.0)).cast("int")
    out = docs.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(w, lambda w: let(bits(w), lambda b: _repeat_words(w, F.size(w), b))),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ngram_buckets(word_col: str | Column, orders: tuple[int, ...] = (1, 2), buckets: int = BUCKETS) -> Column:
    """Buckets of all n-grams of the words, repeats included."""

    def of_order(w: Column, n: int) -> Column:
        if n == 1:
            return F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(*[F.get(w, i + k) for k in range(n)]), F.lit(buckets)).cast("int"))

    return let(F.col(word_col) if isinstance(word_col, str) else word_col, lambda w: F.concat(*[of_order(w, n) for n in orders]))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = (1, 2), buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket between the documents whose id is in ``trusted`` and all documents.

    Counts cover every n-gram of every whole text, with 1 added to each bucket; no more than ``buckets`` numbers
    come to the driver. Repeated ids in ``trusted`` count once, repeated documents as often as they are there.
    """
    import math

    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_in", F.lit(1))
    # Texts move once, uncut (arrays of their words take over twice the room) and unsorted, to the ids' hash tables; the plan is one at every size.
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids.hint("shuffle_hash"), "_id", "left")
    one = marked.select("_in", F.explode(ngram_buckets(words("_text"), orders, buckets)).alias("b"))
    counts = one.groupBy("b").agg(F.count(F.lit(1)).alias("every"), F.count("_in").alias("good")).collect()
    every, good = [1] * buckets, [1] * buckets
    for r in counts:
        every[r.b] += r.every
        good[r.b] += r.good
    n, m = sum(every), sum(good)
    return [math.log((g / m) / (e / n)) for g, e in zip(good, every)]


def ratio_score(word_col: str, ratio: list[float], orders: tuple[int, ...] = (1, 2)) -> Column:
    """Mean log ratio of the n-grams of a text; NULL if it has none."""
    table = F.split(F.lit(",".join(repr(x) for x in ratio)), ",").cast("array<double>")  # one folded literal of as many numbers as buckets
    b = ngram_buckets(word_col, orders, len(ratio))
    total = let(table, lambda t: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(t, x)))
    w = F.size(word_col)
    count = sum((F.greatest(w - (n - 1), F.lit(0)) for n in orders), F.lit(0))
    return F.try_divide(total, count)


def judge(docs: DataFrame, ratio: list[float], threshold: float = 0.0, text_col: str = "text", orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """All rows with the base rules, ``quality_score`` and ``kept``: base rules passed and score at or over the threshold.

    NULL and empty texts have no n-grams: score NULL, base rules failed, not kept. Every row is judged by itself, so repeated
    rows get equal results; very long texts are judged whole; an empty table gives no rows. All columns are kept; one that has
    the name of a result raises ValueError.
    """
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    rows = base_rules(held.withColumn("_words", words("text")), "text")
    rows = rows.withColumn("quality_score", ratio_score("_words", ratio, orders))
    rows = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality_score") >= threshold, F.lit(False))).drop("_words", "text")
    made = [c for c in rows.columns if c != "row"]
    if taken := sorted(set(made) & set(docs.columns)):
        raise ValueError(f"columns {taken} exist")
    return rows.select("row.*", *made)
