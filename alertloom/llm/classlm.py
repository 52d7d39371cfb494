"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

The most frequent training words and, for all others, groups of words with the same hashed ending are clustered
by the exchange algorithm, which moves one unit at a time to the class that raises the corpus likelihood most. From
there every training word gets a class of its own: sweeps over the whole corpus count the classes before and after
each word, and each word takes the class that explains them best. Groups of endings stay for unseen words only.
A token's probability mixes P(class | class before) * P(word | class) with the smoothed frequency of the word alone.

Texts are cut once into 64-bit word ids, whose low bits are the group of the ending; counts and classes of the most
frequent words are held as plain arrays and texts become places in them, so a sweep is a look-up of classes. The
words beyond meet their classes in joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import doc_type, materialise, with_row_id

#: Words that are units of their own, groups of endings for the rest, and classes besides that of the text's end.
UNIT_WORDS, ENDINGS, CLASSES = 1024, 512, 48
#: Sweeps over the corpus that give every word its class; they stop early when the likelihood does not rise.
SWEEPS = 2
#: Most words whose counts and classes are held in every worker, 17 bytes each; those of all others are joined.
HELD_WORDS = 1 << 22
#: Tokens whose neighbours' classes a worker counts before it passes them on.
COUNTED = 2_000_000
#: Words whose ids a worker keeps, and texts that are cut into words together.
CACHE, DOCS = 300_000, 2048
#: Id of a text's end, and a neighbour's class and how often it was met, as bytes.
STOP, NEAR = -1, [("code", "u1"), ("n", ">u4")]


@dataclass
class Model:
    """A fitted model. ``counts`` is the written table (id, c, k) of all training words and their classes; the rest is bounded."""

    counts: DataFrame
    least: int  # words of at least so many tokens are held
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ending_class: Any  # class of each group of endings, for unseen words
    transitions: Any  # P(class | class before)
    emission_sizes: Any  # denominators of P(word | class)
    smooth: float = 0.1
    class_weight: float = 0.9


def word_id(word: bytes) -> int:
    """Id of a word, never negative: 54 bits of its hash, then the group of its ending, the last three bytes."""
    import zlib

    import xxhash

    return xxhash.xxh64_intdigest(word) & 0x7FFF_FFFF_FFFF_FFFF & -ENDINGS | zlib.crc32(word[-3:]) % ENDINGS


class _Ids(dict):
    def __missing__(self, word):
        got = word_id(word)
        if len(self) < CACHE and len(word) < 64:
            self[word] = got
        return got


def _words(texts, ids: _Ids):
    """The words of an Arrow column of texts, lower-cased: ids of the distinct ones, which of them stands where, and how many each
    text has; NULL texts have none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # A new array: the cast of a slice that has no bitmap of NULLs reads from the first text on.
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts.to_pylist()], pa.large_string())))
    parts = split.flatten().dictionary_encode()
    found = parts.dictionary.cast(pa.large_binary()).to_pylist()
    at, sizes = parts.indices.to_numpy(), split.value_lengths().to_numpy().astype(np.int64)
    if b"" in found:  # stands before, after and instead of words
        real = at != found.index(b"")
        at, sizes = at[real], _times(_owners(sizes)[real], len(sizes))
    return np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), at, sizes


def _list_array(values, sizes):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _word_ids(batches):
    """mapInArrow: texts to arrays of the ids of their words."""
    import pyarrow as pa

    ids = _Ids()
    for batch in batches:
        for i in range(0, batch.num_rows, DOCS):
            distinct, at, sizes = _words(batch.column(0).slice(i, DOCS), ids)
            yield pa.RecordBatch.from_arrays([_list_array(distinct[at], sizes)], names=["ids"])


def _stopped(values, sizes, stop: int):
    """All texts' values behind each other, ``stop`` first and after each text."""
    import numpy as np

    out = np.full(len(values) + len(sizes) + 1, stop, values.dtype)
    out[np.arange(len(values)) + 1 + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out


def _column(column):
    """Values and sizes of an Arrow list column."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False)


def _counts(batches):
    """mapInArrow: arrays of ids to (id, n), summed over some batches."""
    import numpy as np
    import pyarrow as pa

    def out(parts):
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        yield from pa.table({"id": ids, "n": n}).to_batches(100_000)

    parts, size = [np.zeros(0, np.int64)], 0
    for batch in batches:
        parts.append(batch.column(0).flatten().to_numpy())
        size += len(parts[-1])
        if size > COUNTED:
            yield from out(parts)
            parts, size = [np.zeros(0, np.int64)], 0
    yield from out(parts)


def _bigrams(unit_ids):
    """mapInArrow: arrays of ids to (code, n): counts of unit pairs, the end standing before the first word too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(unit_ids)
        known, end = unit_ids[order], ENDINGS + len(unit_ids)
        side = end + 1
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            values, sizes = _column(batch.column(0))
            units = values % ENDINGS
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                units = np.where(known[at] == values, ENDINGS + order[at], units)
            a = _stopped(units, sizes, end)
            total += np.bincount(a[:-1] * side + a[1:], minlength=side * side)
        codes = np.flatnonzero(total)
        yield from pa.table({"code": codes, "n": total[codes]}).to_batches(100_000)

    return run


def _exchange(side: int):
    """mapInArrow over one partition: (code, n) of all unit pairs to (unit, class)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairs = np.zeros(side * side)
        for batch in batches:
            pairs[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        cls = exchange(pairs.reshape(side, side), CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(side)), pa.array(cls)], names=["unit", "k"])

    return run


def exchange(pairs, classes: int, sweeps: int = 8):
    """Classes of units from their bigram counts (a square array) by the exchange algorithm.

    The last unit, the end of a text, keeps a class of its own, number ``classes``. Units start in turn, by frequency;
    each sweep takes every unit out of its class and puts it where sum n log n of class pairs less that of class
    sizes is highest, ties to the smaller class. Stops when a sweep moves nothing.
    """
    import numpy as np

    pairs = np.asarray(pairs, np.float64)
    n = len(pairs)
    cls = np.full(n, classes)
    order = np.argsort(-(pairs.sum(0)[:-1]), kind="stable")
    cls[order] = np.arange(n - 1) % classes
    one = np.zeros((n, classes + 1))
    one[np.arange(n), cls] = 1
    right, left = pairs @ one, pairs.T @ one  # of each unit: counts by class after it, before it
    both = one.T @ right
    log = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own, own_pair = cls[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()  # noqa: E741
            if not r.sum() + l.sum():
                continue
            r[own] -= own_pair
            l[own] -= own_pair
            both[own, :] -= r
            both[:, own] -= l
            both[own, own] -= own_pair
            # Class sizes without u itself; pairs with u count for the classes of its neighbours.
            row, col, diag = both.sum(1) + l, both.sum(0) + r, np.diag(both)
            gain = (log(both + r) - log(both)).sum(1) + (log(both + l[:, None]) - log(both)).sum(0)
            gain += log(diag + r + l + own_pair) - log(diag + r) - log(diag + l) + log(diag)
            gain -= log(row + r.sum() + own_pair) - log(row) + log(col + l.sum() + own_pair) - log(col)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[own] + 1e-9:
                new = own
            both[new, :] += r
            both[:, new] += l
            both[new, new] += own_pair
            if new != own:
                moved += 1
                cls[u] = new
                right[:, own] -= pairs[:, u]
                right[:, new] += pairs[:, u]
                left[:, own] -= pairs[u, :]
                left[:, new] += pairs[u, :]
        if not moved:
            break
    return cls


def _first_classes(unit_ids, cls):
    """mapInArrow: (id, c) to (id, c, class of its unit)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(unit_ids)
        known = unit_ids[order]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            k = cls[ids % ENDINGS]
            if len(known):
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                k = np.where(known[at] == ids, cls[ENDINGS + order[at]], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int32())], names=["id", "c", "k"])

    return run


def held_from(counts: DataFrame) -> int:
    """The least count such that at most HELD_WORDS words have it or more; counts over 1,024 are told apart by their highest bit."""
    level = F.when(F.col("c") <= 1024, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("c").cast("double")))).cast("long"))
    found = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, 2**62
    for at, n in found:
        total += n
        if total > HELD_WORDS:
            break
        least = at
    return least


def held_words(table: DataFrame, least: int, counted: bool = False):
    """The held words, sorted by id: ids, counts if wanted, and classes (bytes); HELD_WORDS at most."""
    import numpy as np

    got = table.where(F.col("c") >= least).select("id", F.col("k").cast("byte").alias("k"), *(["c"] if counted else [])).toArrow()
    ids = got["id"].to_numpy()
    order = np.argsort(ids).astype(np.int32)
    return tuple(got[x].to_numpy()[order] for x in (("id", "c", "k") if counted else ("id", "k")))


def find(held, ids):
    """Places of ids among the sorted held ones, -1 for those that aren't held."""
    import numpy as np

    if not len(held):
        return np.full(len(ids), -1, np.int32)
    at = np.minimum(np.searchsorted(held, ids), len(held) - 1).astype(np.int32)
    return np.where(held[at] == ids, at, np.int32(-1))


def _places(shared):
    """mapInArrow: arrays of ids to arrays of places among the held words, and the ids that have none, in their order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, sizes = _column(batch.column(0))
            distinct = pa.array(values).dictionary_encode()
            at = find(shared.value[0], distinct.dictionary.to_numpy())[distinct.indices.to_numpy()]
            none = at < 0
            owner = _owners(sizes)[none]
            yield pa.RecordBatch.from_arrays([_list_array(at, sizes), _list_array(values[none], _times(owner, len(sizes)))], names=["at", "rest"])

    return run


def _owners(sizes):
    """Number of the text that each value belongs to."""
    import numpy as np

    return np.repeat(np.arange(len(sizes)), sizes)


def _times(owner, n: int):
    import numpy as np

    return np.bincount(owner, minlength=n)


def _neighbours(batch, held, classes):
    """For all neighbouring tokens of a batch of places: places (-1: not held, the number of held words: the end), ids and classes."""
    import numpy as np

    values, sizes = _column(batch.column(0))
    at = _stopped(values, sizes, len(held))
    ids = np.append(held, STOP)[at]
    ids[at < 0] = batch.column(1).flatten().to_numpy()
    k = np.append(classes, np.int8(CLASSES))[at].astype(np.int64)
    k[at < 0] = -1
    return at, ids, k


def _pairs(shared, classes):
    """mapInArrow: places to (code, n), n pairs of held words of two classes, and (a, ka, b, kb), a pair of which one at least isn't held."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        side, kinds = CLASSES + 1, (("code", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("ka", pa.int32()), ("b", pa.int64()), ("kb", pa.int32()))
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            _, ids, k = _neighbours(batch, shared.value[0], classes.value)
            x, y = k[:-1], k[1:]
            ok = (x >= 0) & (y >= 0)
            total += np.bincount(x[ok] * side + y[ok], minlength=side * side)
            if not ok.all():
                cols = (ids[:-1][~ok], x[~ok], ids[1:][~ok], y[~ok])
                yield from pa.table([pa.nulls(len(cols[0]), t) for _, t in kinds[:2]] + [pa.array(c, t) for c, (_, t) in zip(cols, kinds[2:])], schema=pa.schema(kinds)).to_batches(100_000)
        at = np.flatnonzero(total)
        yield from pa.table([pa.array(at), pa.array(total[at])] + [pa.nulls(len(at), t) for _, t in kinds[2:]], schema=pa.schema(kinds)).to_batches()

    return run


def _near(shared, classes):
    """mapInArrow: places to (id, k, near): a held word, its class, and the classes before it and (from CLASSES + 1) after it,
    as bytes of NEAR; of neighbours that are held both."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, side = shared.value[0], CLASSES + 1

        def out(parts):
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            word = codes // (2 * side)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            for i in range(0, len(first), 100_000):
                some = first[i : i + 100_000]
                stop = first[i + 100_000] if i + 100_000 < len(first) else len(codes)
                data = np.empty(stop - some[0], NEAR)
                data["code"], data["n"] = codes[some[0] : stop] % (2 * side), n[some[0] : stop]
                offsets = (np.append(some, stop) - some[0]).astype(np.int32) * data.itemsize
                near = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(held[word[some]]), pa.array(classes.value[word[some]], pa.int32()), near], names=["id", "k", "near"])

        parts, size = [], 0
        for batch in batches:
            at, _, k = _neighbours(batch, held, classes.value)
            at = at.astype(np.int64)
            x, y = at[:-1], at[1:]
            ok = (x >= 0) & (y >= 0)
            after, before = ok & (x < len(held)), ok & (y < len(held))
            parts += [x[after] * (2 * side) + side + k[1:][after], y[before] * (2 * side) + k[:-1][before]]
            size += len(at)
            if size > COUNTED:
                yield from out(parts)
                parts, size = [], 0
        if parts:
            yield from out(parts)

    return run


def likelihood(both) -> float:
    """The part of the corpus' log likelihood that the classes change."""
    import numpy as np

    log = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return log(both) - log(both.sum(0)) - log(both.sum(1))


def best_classes(both, near, own, smooth: float):
    """For each row of ``near``, counts of the classes before a word and after it, the class that explains them best.

    In its ``own`` class a word is judged without its own counts. Ties stay, then go to the smaller class.
    """
    import numpy as np

    side, rows = CLASSES + 1, np.arange(len(near))
    share = lambda x: np.log((x + smooth) / (x.sum(-1, keepdims=True) + smooth * side))
    left, right = near[:, :side], near[:, side:]
    gain = (right @ share(both).T + left @ share(both.T).T)[:, :CLASSES]
    alone = (right * share(np.maximum(both[own] - right, 0))).sum(1) + (left * share(np.maximum(both.T[own] - left, 0))).sum(1)
    gain[rows, own] = alone
    new = np.argmax(gain, 1)
    return np.where(gain[rows, new] > alone + 1e-9, new, own)


def _choose(both, smooth: float):
    """mapInArrow: (id, k, near), equal ids behind each other, to (id, c, class whose neighbours explain those of the word best)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        side = CLASSES + 1

        def out(ids, own, near):
            for i in range(0, len(ids), 5_000):
                part = slice(i, i + 5_000)
                k = best_classes(both, near[part], own[part], smooth)
                c = near[part, :side].sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(c), pa.array(k, pa.int32())], names=["id", "c", "k"])

        # The last word of a batch may go on in the next.
        ids, own, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2 * side))
        for batch in batches:
            column = batch.column(2)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(NEAR)
            every = np.append(ids, batch.column(0).to_numpy())
            new = np.append(True, every[1:] != every[:-1]) if len(every) else np.zeros(0, bool)
            place = np.cumsum(new) - 1
            mine = np.zeros((int(place[-1]) + 1 if len(place) else 0, 2 * side))
            rows = np.repeat(place[len(ids) :], np.diff(offsets) // data.itemsize)
            mine += np.bincount(rows * (2 * side) + data["code"], data["n"].astype(np.float64), mine.size).reshape(mine.shape)
            mine[: len(near)] += near
            ids, own, near = every[new], np.append(own, batch.column(1).to_numpy())[new], mine
            yield from out(ids[:-1], own[:-1], near[:-1])
            ids, own, near = ids[-1:], own[-1:], near[-1:]
        yield from out(ids, own, near)

    return run


def _square(rows: DataFrame):
    """Counts of class pairs, a square array, from (code, n)."""
    import numpy as np

    side = CLASSES + 1
    both = np.zeros(side * side)
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        both[r.code] = r.n
    return both.reshape(side, side)


def _unheld(table: DataFrame, least: int, *names: str) -> DataFrame:
    """Words that aren't held, under other column names."""
    return table.where(F.col("c") < least).select(*(F.col(a).alias(b) for a, b in zip(("id", "k", "c"), names)))


def _key(wanted: Column, ident: str, other: Column) -> Column:
    """The id where it is to be looked up, else a negative number that matches none and spreads the rows."""
    return F.when(wanted, F.col(ident)).otherwise(-2 - F.abs(other % (1 << 40)))


def fit(docs: DataFrame, text_col: str = "text", smooth: float = 0.1, class_weight: float = 0.9) -> Model:
    """Fit on all given documents. Counts and classes cover every token and word of whole texts.

    NULL and empty texts have an end alone; repeated rows count as often as they stand; an empty table gives a model without
    words. Only the text is read, so other columns of any name do no harm. Ties between classes go to the smaller one, between
    units to the smaller id. Words are told apart by 64-bit ids; words that share one (3 pairs among 10**10) count as one.
    To the driver come the ids and classes of the units, one number per pair of classes, the totals and the held words.
    """
    import numpy as np

    spark = docs.sparkSession
    texts = materialise(docs.select(F.col(text_col).cast("string")).mapInArrow(_word_ids, "ids array<long>"))
    counts = materialise(texts.mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("c")))
    n_docs = texts.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    unit_ids = np.array([r.id for r in counts.orderBy(F.col("c").desc(), "id").limit(UNIT_WORDS).collect()], np.int64)
    side = ENDINGS + len(unit_ids) + 1
    # One number per pair of units runs through one task.
    made = texts.mapInArrow(_bigrams(unit_ids), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    cls = made.repartition(1).mapInArrow(_exchange(side), "unit long, k long").toArrow().sort_by("unit")["k"].to_numpy()
    cls = cls if len(cls) else np.zeros(side, np.int64)  # no text, no pairs

    table = counts.mapInArrow(_first_classes(unit_ids, cls), "id long, c long, k int")
    least = held_from(counts)
    ids, classes = held_words(table, least)
    shared = spark.sparkContext.broadcast((ids,))
    places = materialise(texts.mapInArrow(_places(shared), "at array<int>, rest array<long>"))
    best, kept, both = None, table, np.zeros((CLASSES + 1, CLASSES + 1))
    for sweep in range(SWEEPS + 1):
        known = spark.sparkContext.broadcast(classes)
        met = materialise(places.mapInArrow(_pairs(shared, known), "code long, n long, a long, ka int, b long, kb int"))
        # Classes of words that aren't held; each has fewer than ``least`` tokens.
        rest = met.where("code is null")
        rest = rest.join(_unheld(table, least, "first", "first_k"), _key(F.col("ka") < 0, "a", F.col("b")) == F.col("first"), "left")
        rest = rest.join(_unheld(table, least, "second", "second_k"), _key(F.col("kb") < 0, "b", F.col("a")) == F.col("second"), "left")
        rest = materialise(rest.select("a", F.coalesce("first_k", "ka").alias("ka"), "b", F.coalesce("second_k", "kb").alias("kb")))
        code = (F.col("ka") * (CLASSES + 1) + F.col("kb")).cast("long")
        now = _square(met.where("code is not null").select("code", "n").union(rest.select(code, F.lit(1).cast("long"))))
        if best is not None and likelihood(now) <= best:
            break
        best, kept, both = likelihood(now), table, now
        if sweep < SWEEPS:
            one = lambda word, k, code: F.struct(F.col(word).alias("id"), F.col(k).alias("k"), code.cast("int").alias("code"))
            each = rest.select(F.explode(F.array(one("a", "ka", F.col("kb") + CLASSES + 1), one("b", "kb", F.col("ka")))).alias("x")).select("x.*")
            each = each.where(F.col("id") != STOP).groupBy("id", "k", "code").agg(F.count(F.lit(1)).alias("n"))
            as_bytes = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
            each = each.select("id", "k", F.concat(as_bytes("code", 2), as_bytes(F.least("n", F.lit(2**32 - 1)), 8)).alias("near"))
            near = places.mapInArrow(_near(shared, known), "id long, k int, near binary").union(each)
            near = near.repartition("id").sortWithinPartitions("id")
            table = materialise(near.mapInArrow(_choose(now, smooth), "id long, c long, k int"))
            classes = held_words(table, least)[1]
            known.destroy()
    transitions = (both + smooth) / (both.sum(1, keepdims=True) + smooth * (CLASSES + 1))
    emission = np.zeros(CLASSES + 1)
    for r in kept.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        emission[r.k] = r.c + smooth * (r.v + 1)  # one more for all unseen words of the class
    emission = np.where(emission > 0, emission, smooth)
    return Model(kept, least, int(total) + n_docs, int(distinct) + (n_docs > 0), cls[:ENDINGS], transitions, emission, smooth, class_weight)


def _local(shared, ending_class, transitions, emission, n_docs, tokens, distinct_words, smooth, weight):
    """mapInArrow: sums over the held tokens that follow held ones, and a list of the others.

    Of these ``a`` and ``b``, the word before and the word, are given where they aren't held, with the class that they
    have if unseen; of held ones only the class and the count are.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, counts, classes = shared.value
        # One entry more: the end of a text, alone in its class.
        freq, unit = np.append(counts.astype(np.int64), n_docs), np.append(classes, np.int8(CLASSES))
        names, ids = ("n_tokens", "n_known", "base", "score", "a", "a_class", "b", "b_class", "b_count"), _Ids()
        for whole in batches:
            for batch in (whole.slice(i, DOCS) for i in range(0, whole.num_rows, DOCS)):
                distinct, where, sizes = _words(batch.column(1), ids)
                n, end = len(sizes), len(distinct)
                # What is looked up and computed for a word is so once for all its places; the end comes after all words.
                found = np.append(find(held, distinct), len(held))
                word, known_word = np.append(distinct, STOP), found >= 0
                k_word = np.where(known_word, unit[found], ending_class[word % ENDINGS]).astype(np.int64)
                freq_word = np.where(known_word, freq[found], 0)
                plain_word = (freq_word + smooth) / (tokens + smooth * (distinct_words + 1))
                emit_word, log_word = np.append(((freq_word + smooth) / emission[k_word])[:-1], 1.0), np.log10(plain_word)
                where, sizes = _stopped(where.astype(np.int64), sizes, end)[1:], sizes + 1
                owner, known, k = _owners(sizes), known_word[where], k_word[where]
                before, seen = np.append(CLASSES, k[:-1])[: len(k)], np.append(True, known[:-1])[: len(k)]
                ok = known & seen
                place = where[ok]
                mixed = np.log10(weight * transitions[before[ok], k[ok]] * emit_word[place] + (1 - weight) * plain_word[place])
                rest = np.flatnonzero(~ok)
                last, here = np.append(end, where[:-1])[: len(where)][rest], where[rest]
                cuts = pa.array(np.append(0, np.cumsum(_times(owner[rest], n))), pa.int32())
                lists = (pa.array(word[last], mask=seen[rest]), pa.array(before[rest], pa.int32()), pa.array(word[here], mask=known[rest]),
                         pa.array(k[rest], pa.int32()), pa.array(freq_word[here]))
                total = lambda of, values, kind: np.bincount(of, values, n).astype(kind)  # noqa: E731  whole numbers if there are no values
                in_known = where[known]
                sums = (sizes, total(owner[known], freq_word[in_known] > 0, np.int64), total(owner[known], log_word[in_known], np.float64), total(owner[ok], mixed, np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *(pa.ListArray.from_arrays(cuts, x) for x in lists)], names=["keep", *names])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score and score of every row.

    Both scores are sums of log10 probabilities over all words of the whole text and one end; base_score takes words alone,
    smoothed by ``smooth``. NULL and empty texts have the end alone. Every row is scored by itself: repeated rows get equal
    scores, an empty table gives no rows. Only ``keep`` is carried, so other columns of any name do no harm. Words beyond the
    held ones meet their counts and classes in joins.
    """
    n_docs = model.tokens - int(model.counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    shared = docs.sparkSession.sparkContext.broadcast(held_words(model.counts, model.least, True))
    run = _local(shared, model.ending_class, model.transitions, model.emission_sizes, n_docs, model.tokens, model.distinct, model.smooth, model.class_weight)
    light = docs.select(F.struct(*keep).alias("keep"), F.col(text_col).cast("string").alias("text"))
    schema = (f"keep {doc_type(light, 'keep')}, n_tokens long, n_known long, base double, score double, a array<long>, "
              "a_class array<int>, b array<long>, b_class array<int>, b_count array<long>")
    rows = materialise(with_row_id(light.mapInArrow(run, schema)))
    tail = rows.select("rid", F.explode(F.arrays_zip("a", "a_class", "b", "b_class", "b_count")).alias("t")).select("rid", "t.*")
    tail = tail.join(_unheld(model.counts, model.least, "first", "first_k"), _key(F.col("a").isNotNull(), "a", F.col("rid")) == F.col("first"), "left")
    tail = tail.join(_unheld(model.counts, model.least, "second", "second_k", "c"), _key(F.col("b").isNotNull(), "b", F.col("rid")) == F.col("second"), "left")
    tail = tail.select("rid", "b", F.coalesce("first_k", "a_class").alias("j"), F.coalesce("second_k", "b_class").alias("k"), F.coalesce("c", "b_count").alias("c"))
    sizes = F.array(*[F.lit(float(x)) for x in model.emission_sizes])
    steps = F.array(*[F.lit(float(x)) for x in model.transitions.ravel()])
    plain = (F.col("c") + model.smooth) / F.lit(model.tokens + model.smooth * (model.distinct + 1))
    emit = F.when(F.col("k") == CLASSES, F.lit(1.0)).otherwise((F.col("c") + model.smooth) / F.get(sizes, "k"))
    mixed = model.class_weight * F.get(steps, F.col("j") * (CLASSES + 1) + F.col("k")) * emit + (1 - model.class_weight) * plain
    rest = tail.groupBy("rid").agg(F.sum(F.when(F.col("b").isNotNull(), F.log10(plain))).alias("base_rest"), F.sum(F.log10(mixed)).alias("score_rest"),
                                   F.count(F.when(F.col("b").isNotNull() & (F.col("c") > 0), 1)).alias("known_rest"))
    zero = F.lit(0.0)
    return rows.select("rid", "keep", "n_tokens", "n_known", "base", "score").join(rest, "rid", "left").select(
        "keep.*", "n_tokens", (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("base_rest", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_rest", zero)).alias("score"))
