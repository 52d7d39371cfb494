"""Language identification by word-first backoff.

A known word scores each language by the logarithm of its frequency there. An unseen word falls back to
its character n-grams, longest first: the 4-grams that are known, else the 3-grams, 2-grams and letters.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.bags import letter_words
from alertloom.llm.common import doc_type, materialise, worker_cache

LONGEST = 4
#: Words that a worker keeps the scores of.
CACHE = 300_000


def grams(word: str, n: int) -> list[str]:
    x = f"<{word}>" if n > 1 else word
    return [x[i : i + n] for i in range(len(x) - n + 1)]


def _counts(batches):
    import pyarrow as pa

    for batch in batches:
        found: dict = defaultdict(int)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in letter_words(text).items():
                found[lang, word] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())],
                                         names=["lang", "word", "n"])


def _grams(batches):
    """mapInArrow: (lang, word, n) to (size, gram, lang, n): the words themselves, size 0, and their n-grams."""
    import pyarrow as pa

    for batch in batches:
        found: dict = defaultdict(int)
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            found[0, word, lang] += n
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    found[size, g, lang] += n
        cols = list(zip(*found)) or [(), (), ()]
        kinds = (pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(list(found.values()), pa.int64())], names=["size", "gram", "lang", "n"])


def _table(rows, langs: list[str]) -> tuple:
    """Plain arrays that ``log_scores`` reads, from an Arrow table (h, gram, lang, n): sorted hashes, where each gram's bytes
    begin, the bytes, where its rows begin, their languages and log frequencies, and the log frequencies of what has no row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.sort_by([("h", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
    gram = rows["gram"].cast(pa.large_string()).combine_chunks()
    begins = np.flatnonzero(np.append(True, pc.not_equal(gram[1:], gram[:-1]).to_numpy(zero_copy_only=False))) if len(gram) else np.zeros(0, np.int64)
    lang = pc.index_in(rows["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int32)
    n = rows["n"].to_numpy()
    totals = np.bincount(lang, n, len(langs)) + 0.5 * (len(begins) + 1)
    gram = gram.take(pa.array(begins))
    sizes = pc.binary_length(gram.cast(pa.large_binary())).to_numpy(zero_copy_only=False)
    data = b"".join(g.encode() for part in range(0, len(gram), 100_000) for g in gram.slice(part, 100_000).to_pylist())
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return rows["h"].to_numpy()[begins], offsets, data, np.append(begins, len(n)), lang, np.log((n + 0.5) / totals[lang]), np.log(0.5 / totals)


def find(table: tuple, found: list[str]):
    """Rows of words or n-grams in the table; -1 for those that it doesn't have."""
    import numpy as np
    import xxhash

    hashes, offsets, data = table[:3]
    raw = [g.encode() for g in found]
    want = np.array([xxhash.xxh64_intdigest(g, 42) for g in raw], np.uint64).view(np.int64)
    at = np.full(len(raw), -1)
    if len(hashes):
        first = np.searchsorted(hashes, want)
        for j in np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == want).tolist():
            i = int(first[j])
            while i < len(hashes) and hashes[i] == want[j]:
                if data[offsets[i] : offsets[i + 1]] == raw[j]:
                    at[j] = i
                    break
                i += 1
    return at


def log_scores(table: tuple, at):
    """Log frequencies by language of rows of the table."""
    import numpy as np

    begins, lang, value, base = table[3:]
    sizes = begins[at + 1] - begins[at]
    out = np.tile(base, (len(at), 1))
    row = np.repeat(np.arange(len(at)), sizes)
    source = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins[at], sizes)
    out[row, lang[source]] = value[source]
    return out


def fit(docs: DataFrame, may_learn: Column, per_lang: int = 3000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"):
    """Learn from at most ``per_lang`` documents of each language, those with the smallest hash of the id.

    Returns (languages, words, n-grams): a language's log frequencies of all words of the sample, and of their n-grams,
    as plain arrays of a row for each language that has the word. They are counted in Spark, and bounded by the sample.
    NULL languages and texts are left out.
    """
    known = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    # The rank needs no texts; the chosen keys, per_lang of a language, are joined to them. Each of 64 parts of a language
    # passes on per_lang keys at most, so the last rank sees no more than 64 times as many, however many tasks read the documents.
    first = lambda df, *keys: df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("draw"))).where(F.col("r") <= per_lang)
    pick = first(first(known.select("lang", "draw", F.pmod(F.xxhash64("draw"), F.lit(64)).alias("part")), "lang", "part"), "lang")
    sample = known.join(pick.select("lang", "draw").distinct(), ["lang", "draw"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    made = counts.mapInArrow(_grams, "size int, gram string, lang string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    made = materialise(made.withColumn("h", F.xxhash64("gram")))
    langs = sorted(r.lang for r in made.select("lang").distinct().collect())
    words, *by_length = (_table(made.where(F.col("size") == i).select("h", "gram", "lang", "n").toArrow(), langs) for i in range(LONGEST + 1))
    return langs, words, by_length


def words_scores(found: list[str], model):
    """Log score of words, a row each, for each language: as a word, else the mean of its longest known n-grams."""
    import numpy as np

    langs, words, by_length = model
    out = np.zeros((len(found), len(langs)))
    at = find(words, found)
    out[at >= 0] = log_scores(words, at[at >= 0])
    left = np.flatnonzero(at < 0)
    for n in range(len(by_length), 0, -1):
        parts = [grams(found[i], n) for i in left]
        owner = np.repeat(left, [len(p) for p in parts])
        at = find(by_length[n - 1], [g for p in parts for g in p])
        owner, at = owner[at >= 0], at[at >= 0]
        np.add.at(out, owner, log_scores(by_length[n - 1], at))
        times = np.bincount(owner, minlength=len(found))
        out /= np.maximum(times, 1)[:, None]
        left = left[times[left] == 0]
    return out


def word_scores(word: str, model) -> tuple[float, ...]:
    """Log score of one word for each language."""
    return tuple(words_scores([word], model)[0].tolist())


def identify(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` (its share among the languages, 0 to 1) of every whole text.

    NULL texts and texts without a letter are ``und`` with score 0, as is all text if nothing was learned. Ties go to
    the smaller language name. Every row is judged by itself and whole, so repeated rows get equal results; an empty table
    gives no rows. Only ``keep`` is carried, so further columns of any name do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tag = f"langid {hash((tuple(model[0]), *(x.tobytes() for t in (model[1], *model[2]) for x in (t[0], t[3], t[4], t[5]))))}"

    def run(batches):
        import pyarrow as pa

        model = shared.value
        langs, cache = model[0], worker_cache(tag)
        for batch in batches:
            pred, scores = [], []
            texts = batch.column(batch.num_columns - 1)
            for i in range(0, len(texts), 500):
                bags = [letter_words(text) for text in texts.slice(i, 500).to_pylist()]
                new = list({word for found in bags for word in found if word not in cache})
                fresh = dict(zip(new, words_scores(new, model).tolist()))
                for found in bags:
                    if not found or not langs:
                        pred.append("und")
                        scores.append(0.0)
                        continue
                    total = [0.0] * len(langs)
                    for word, n in found.items():
                        x = cache.get(word) or fresh[word]
                        total = [t + n * v for t, v in zip(total, x)]
                    best = max(total)
                    pred.append(langs[total.index(best)])
                    scores.append(1.0 / sum(math.exp(max(-700.0, t - best)) for t in total))
                for word in new[: CACHE - len(cache)] if len(cache) < CACHE else ():
                    cache[word] = fresh[word]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    light = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return light.mapInArrow(run, ", ".join([*(f"`{c}` {doc_type(light, c)}" for c in keep), "lang_pred string", "score double"]))
