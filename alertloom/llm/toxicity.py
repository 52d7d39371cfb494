"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its letter words; a word is itself and its character 3- to 5-grams, hashed to
buckets. The embeddings of all buckets, weighted by inverse document frequency, are averaged and a
linear softmax over the average gives P(toxic). Misspellings share most n-gram vectors with the words
they come from.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bags import letter_words
from alertloom.llm.common import doc_type, lean, materialise, worker_cache

BUCKETS, NGRAMS = 1 << 16, (3, 4, 5)
#: Words that a worker keeps the sums of, and texts whose new words are hashed together.
CACHE, DOCS = 200_000, 512
#: Parts of an epoch over which the repeats of a toxic text are spread; more of them follow each other.
MOST_COPIES = 8


def subwords(words: list[str]):
    """Distinct buckets of each word, behind each other and sorted, and how many each word has.

    A word's buckets are those of itself and of its character n-grams, with marks at both ends. All words' n-grams are hashed
    at once, by a polynomial of their code points.
    """
    import zlib

    import numpy as np

    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, ends = np.repeat(np.arange(len(marked)), sizes), np.cumsum(sizes)
    left = ends[owner] - np.arange(len(points)) if len(points) else np.zeros(0, np.int64)
    odd, shift, bits = np.uint64(0x9E3779B97F4A7C15), np.uint64(48), np.int64(BUCKETS.bit_length() - 1)
    wholes = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in marked), np.int64, len(marked))
    keys = [np.arange(len(marked)) << bits | wholes]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * odd
            h ^= h >> np.uint64(29)
        keys.append(owner[at] << bits | (h * odd >> shift).astype(np.int64))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & BUCKETS - 1, np.bincount(keys >> bits, minlength=len(words))


def damped(count: int) -> float:
    """Weight of a word that occurs ``count`` times, so that one repeated word doesn't make up a text."""
    return 1.0 + math.log(count)


def bag(text: str | None):
    """Distinct buckets of a text and their share of its bag."""
    import numpy as np

    found = letter_words(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    parts, sizes = subwords(list(found))
    weights = np.repeat([damped(n) for n in found.values()], sizes)
    ids, where = np.unique(parts, return_inverse=True)
    return ids, np.bincount(where, weights) / weights.sum()


def new_words(bags: list, cache: dict) -> list[str]:
    """The distinct words of some bags that the cache doesn't have."""
    return list({word for found in bags for word in found if word not in cache})


class Trainer:
    """Embeddings and softmax, learned jointly by stochastic gradient steps with Adagrad rates.

    ``rare`` weighs the buckets. The softmax is linear in the average of a bag, so a bucket's effect on the logit is its
    embedding times the difference of the two classes' weights.
    """

    def __init__(self, rare, dim: int = 8, rate: float = 0.3, seed: int = 0):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.rare, self.rate = rare, rate
        self.emb, self.out, self.bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
        self.emb_sq, self.out_sq = np.full(BUCKETS, 1e-4), 1e-4

    def learn(self, ids, share, label: int) -> None:
        """One step with the buckets of a text and their shares of its bag."""
        import numpy as np

        if not len(ids):
            return
        share = share * self.rare[ids]
        mean = share @ self.emb[ids]
        z = mean @ self.out + self.bias
        grad = np.exp(z - z.max())
        grad /= grad.sum()
        grad[label] -= 1
        back, out_grad = self.out @ grad, np.outer(mean, grad)
        self.emb_sq[ids] += share**2 * (back**2).mean()
        self.out_sq += (out_grad**2).mean()
        self.emb[ids] -= (self.rate * share / np.sqrt(self.emb_sq[ids]))[:, None] * back
        self.out -= 0.3 * self.rate * out_grad / np.sqrt(self.out_sq)
        self.bias -= 0.1 * self.rate * grad

    def effects(self):
        """Effect of each bucket on the logit of toxic, the bias last."""
        import numpy as np

        return np.append(self.emb @ (self.out[:, 1] - self.out[:, 0]) * self.rare, self.bias[1] - self.bias[0])


def _frequencies(batches):
    """mapInArrow: texts to (bucket, n), n of the partition's texts having the bucket; bucket BUCKETS counts all texts."""
    import numpy as np
    import pyarrow as pa

    # A text marks its buckets; marks of up to 255 texts are summed in bytes.
    total, mark, some, left, cache = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, np.uint8), np.zeros(BUCKETS, np.uint8), 255, {}
    for batch in batches:
        total[BUCKETS] += batch.num_rows
        for i in range(0, batch.num_rows, DOCS):
            bags = [letter_words(text) for text in batch.column(0).slice(i, DOCS).to_pylist()]
            new = new_words(bags, cache)
            ids, sizes = subwords(new)
            raw, ends = ids.astype("<u2").tobytes(), (2 * np.cumsum(sizes)).tolist()
            cache.update((word, raw[j:k]) for word, j, k in zip(new, [0, *ends], ends))
            for found in bags:
                if found:
                    mark[:] = 0
                    mark[np.frombuffer(b"".join(map(cache.__getitem__, found)), "<u2")] = 1
                    some += mark
                    left -= 1
                    if not left:
                        total[:BUCKETS] += some
                        some[:], left = 0, 255
            if len(cache) > CACHE // 2:
                cache.clear()
    total[:BUCKETS] += some
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def rarity(docs: DataFrame, text_col: str = "text", scale: float = 30.0):
    """Weight of each bucket: ``scale`` times the logarithm of (texts + 1) / (texts that have it + 1), over all documents."""
    import numpy as np

    texts = docs.select(F.col(text_col).cast("string"))
    got = texts.mapInArrow(lean(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS + 1)
    n[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return np.log((n[-1] + 1) / (n[:-1] + 1)) * scale


def _bags(batches):
    """mapInArrow: (draw, toxic, text) to (draw, toxic, ids, share): buckets as "<u2" and shares as "<f4" bytes."""
    import pyarrow as pa

    for batch in batches:
        made = [bag(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()),
                                          pa.array([s.astype("<f4").tobytes() for _, s in made], pa.binary())], names=["draw", "toxic", "ids", "share"])


def _train(shared):
    """mapInArrow over one partition: bags in the order in which they are learned to (bucket, effect), the bias as bucket BUCKETS."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trainer = Trainer(shared.value)
        for batch in batches:
            for label, ids, share in zip(*(batch.column(i).to_pylist() for i in range(3))):
                trainer.learn(np.frombuffer(ids, "<u2").astype(np.int64), np.frombuffer(share, "<f4").astype(np.float64), label)
        effects = trainer.effects()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(effects)), pa.int32()), pa.array(effects)], names=["bucket", "effect"])

    return run


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, toxic, text) of the documents to learn from: at most ``per_label`` ids of each label, those with the smallest hash."""
    known = labels.where(may_learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    draw = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
    chosen = F.broadcast(draw(0).union(draw(1)))  # per_label rows of each label at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id")
    return texts.groupBy("_id", "toxic").agg(F.min("_text").alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = 4000, epochs: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Fit on the labelled documents that ``may_learn`` (over the labels) allows: (effect of each bucket, bias).

    At most ``per_label`` ids of each label take part, those with the smallest hash; of repeated ids the least text counts.
    Other labels than 0 and 1, NULL labels and NULL ids are left out; empty texts teach nothing. The buckets' weights come
    from all documents. The bags are written once and run ``epochs`` times through one task, which holds the model and a
    batch of them; toxic ones are repeated or thinned to about a third of the clean ones. The driver gets one number a bucket.
    Without both labels the effects are 0 and the bias says which label there is; without labels nothing is toxic.
    """
    import math

    import numpy as np

    texts = sample(docs, labels, may_learn, per_label, id_col, text_col, label_col)
    rows = texts.select(F.xxhash64("_id").alias("draw"), "toxic", "_text")
    bags = materialise(rows.mapInArrow(lean(_bags), "draw long, toxic int, ids binary, share binary").repartition(8, "draw").sortWithinPartitions("draw"))
    sizes = {r.toxic: r.n for r in bags.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(BUCKETS), 20.0 if 1 in sizes else -20.0
    wanted = max(1, sizes[0] // 3) / sizes[1]  # times that a toxic document is learned in an epoch, on average
    copies = min(MOST_COPIES, math.ceil(wanted))

    def turn(epoch: int, copy: int) -> DataFrame:
        """A part of the clean bags, and the toxic ones, each ``wanted / copies`` times on average."""
        chance = F.pmod(F.xxhash64("draw", F.lit(epoch), F.lit(copy)), F.lit(1_000_003)) / 1_000_003
        times = F.when(F.col("toxic") == 1, F.floor(wanted / copies + chance)).otherwise((F.pmod(F.xxhash64("draw"), F.lit(copies)) == copy).cast("int"))
        return bags.withColumn("_", F.explode(F.array_repeat(F.lit(True), times.cast("int")))).select("toxic", "ids", "share")

    order = reduce(DataFrame.union, [turn(e, c) for e in range(epochs) for c in range(copies)]).coalesce(1)
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col))
    got = order.mapInArrow(lean(_train(shared)), "bucket int, effect double").toArrow().sort_by("bucket")
    effects = got["effect"].to_numpy()
    return effects[:-1], float(effects[-1])


def score(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns and P(toxic) of every whole text.

    NULL, empty and letterless texts get the bias alone. Every row is scored by itself: repeated rows get equal scores, ties
    need no rule, very long texts are scored whole, an empty table gives no rows. Only ``keep`` is carried, so further columns
    of any name do no harm.
    """
    import numpy as np

    effects, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(effects, np.float64), float(bias)))
    tag = f"toxicity {hash(np.asarray(effects).tobytes())} {bias}"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        effects, bias = shared.value
        cache = worker_cache(tag)
        for batch in batches:
            scores = []
            for i in range(0, batch.num_rows, DOCS):
                bags = [letter_words(text) for text in batch.column(batch.num_columns - 1).slice(i, DOCS).to_pylist()]
                new = new_words(bags, cache)
                ids, sizes = subwords(new)
                sums = np.add.reduceat(effects[ids], np.cumsum(sizes) - sizes) if new else np.zeros(0)
                fresh = dict(zip(new, zip(sums.tolist(), sizes.tolist())))
                for found in bags:
                    total = size = 0.0
                    for word, n in found.items():
                        known = cache.get(word) or fresh[word]
                        w = damped(n) if n > 1 else 1.0
                        total += w * known[0]
                        size += w * known[1]
                    logit = bias + (total / size if size else 0.0)
                    scores.append(1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, logit)))))
                for word in new[: max(0, CACHE - len(cache))]:
                    cache[word] = fresh[word]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], score_col])

    light = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return light.mapInArrow(lean(run), ", ".join([*(f"`{c}` {doc_type(light, c)}" for c in keep), f"`{score_col}` double"]))


def drop_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold; NULL and empty texts follow the bias."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    return score(held, model, ("doc",)).where(F.col("score") < threshold).select("doc.*")
