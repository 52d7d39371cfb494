"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

A text is cut into words, runs of letters and digits or of other signs; its words and pairs of neighbours are hashed
to buckets. Its features are the shares of the buckets among all its n-grams. The weights come from FTRL-proximal
updates, one labelled text at a time, which keep the weights of buckets without evidence at zero; a text's score is
the logistic function of the sparse dot product of its features with the weights.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import doc_type, worker_cache

BUCKETS = 1 << 18
#: Words that a worker keeps the hashes of.
CACHE = 500_000
#: Factor of the shares, so that a tenth of a text's n-grams moves its score.
SCALE = 20.0
_WORDS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
#: Stands for a word that repeats the one before it, whichever word that is.
SAME = "\n"


def word_hashes(text: str | None, cache: dict):
    """64-bit hashes of a text's words, lower-cased, repeats of the word before as one mark; ``cache`` maps words to hashes."""
    import numpy as np
    import xxhash

    found = _WORDS.findall(text.lower()) if text else []
    out = list(map(cache.get, found))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                word = found[i]
                h = out[i] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
                if len(cache) < CACHE and len(word) < 64:
                    cache[word] = h
    h = np.array(out, np.uint64)
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    h[again] = xxhash.xxh64_intdigest(SAME)
    return h


def ngram_ids(text: str | None, cache: dict):
    """Buckets of all words and pairs of neighbours of a text, repeats included."""
    import numpy as np

    h = word_hashes(text, cache)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKETS.bit_length() + 1)
    pairs = (h[:-1] * mix) ^ h[1:]
    return (np.concatenate([h, pairs]) * mix >> shift).astype(np.int64)


def features(text: str | None, cache: dict):
    """Distinct buckets of a text and ``SCALE`` times their shares of its n-grams; nothing for NULL and texts without words."""
    import numpy as np

    ids, n = np.unique(ngram_ids(text, cache), return_counts=True)
    return ids, n * (SCALE / max(1, n.sum()))


class Ftrl:
    """FTRL-proximal logistic regression with per-bucket rates; the last entry of the arrays is the bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        import numpy as np

        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at):
        """Weights of the entries ``at``: the minimum of the regularised loss so far."""
        import numpy as np

        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, ids, values, label: int, weight: float = 1.0) -> None:
        """One update with a text's features."""
        import numpy as np

        at, x = np.append(ids, BUCKETS), np.append(values, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -50.0, 50.0))) - label) * weight * x
        before = self.n[at]
        self.n[at] = before + g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - np.sqrt(before)) / self.alpha * w


def _bags(batches):
    """mapInArrow: (id, label, weight, text) to (draw, label, weight, ids, values)."""
    import pyarrow as pa

    cache = worker_cache("goodness")
    for batch in batches:
        ids, values = [], []
        for text in batch.column(3).to_pylist():
            i, v = features(text, cache)
            ids.append(i.astype("int32"))
            values.append(v.astype("float32"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                                         names=["draw", "label", "weight", "ids", "values"])


def _train(batches):
    """mapInArrow over one ordered partition: labelled bags to (at, w), the weights that are not zero."""
    import numpy as np
    import pyarrow as pa

    model = Ftrl()
    for batch in batches:
        label, weight = (batch.column(i).to_pylist() for i in (0, 1))
        for i in range(batch.num_rows):
            model.learn(*(batch.column(k)[i].values.to_numpy().astype(t) for k, t in ((2, np.int64), (3, np.float64))), label[i], weight[i])
    w = model.weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000], pa.int32()), pa.array(w[at[i : i + 50_000]])], names=["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = 4000, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality"):
    """Weights of all buckets, the bias last, learned from the labelled documents that ``may_learn`` (over the labels) allows.

    At most ``per_label`` ids of each label take part, those with the smallest hash; both labels weigh the same in sum, however
    many rows they have. Of repeated ids the least text counts; an id with both labels is learned with both. Labels other than
    0 and 1, NULL labels and NULL ids are left out; NULL and empty texts teach the bias alone. The bags, at most 2 * per_label,
    run through one task ``epochs`` times in the order of a hash; only the weights, BUCKETS + 1 numbers at most, come to the driver.
    With one label alone the bias says which, without labels all weights are zero.
    """
    import numpy as np

    weights = np.zeros(BUCKETS + 1)
    known = labels.where(may_learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null").distinct()
    draw = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
    chosen = F.broadcast(draw(0).union(draw(1)))  # per_label rows of each label at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id")
    texts = texts.groupBy("_id", "label").agg(F.min("_text").alias("_text"))
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        weights[-1] = {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(sizes)]
        return weights
    share = sum(sizes.values()) / 2
    weight = F.when(F.col("label") == 1, share / sizes[1]).otherwise(share / sizes[0])
    rows = texts.select(F.xxhash64("_id").alias("draw"), "label", weight.alias("weight"), "_text")
    bags = rows.mapInArrow(_bags, "draw long, label int, weight double, ids array<int>, values array<float>")
    turns = bags.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    turns = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("draw", "epoch"), "draw", "label")
    got = turns.select("label", "weight", "ids", "values").mapInArrow(_train, "at int, w double").toArrow()
    weights[got["at"].to_numpy()] = got["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns and P(label 1) of every whole text.

    NULL, empty and wordless texts get the bias alone. Every row is scored by itself, so repeated rows get equal scores and
    ties need no rule; an empty table gives no rows. Only ``keep`` is carried, under its own names, so further columns of any
    name do no harm; the result has no two columns of one name unless ``keep`` holds ``score_col``, which raises ValueError.
    """
    import numpy as np

    if score_col in keep:
        raise ValueError(f"column {score_col} exists")
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, cache = shared.value, worker_cache("goodness")
        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ids = ngram_ids(text, cache)
                logits[i] = w[ids].sum() * (SCALE / max(1, len(ids))) + w[-1]
            scores = 1.0 / (1.0 + np.exp(-np.clip(logits, -700.0, 700.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], score_col])

    light = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return light.mapInArrow(run, ", ".join([*(f"`{c}` {doc_type(light, c)}" for c in keep), f"`{score_col}` double"]))
