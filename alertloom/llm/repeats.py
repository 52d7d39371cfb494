"""Repeated-phrase automata: remove words of 20-word windows that occur earlier.

Every window has an anchor, the 8-word gram of least hash in it, so equal windows have equal anchors.
Anchors that stand at one place only are counted out first; around the others the documents are cut into
segments, which go to shards by anchor. A shard confirms the windows that recur in it, compiles them to
an Aho-Corasick automaton over word codes and streams all its segments through it; what it finds goes back
to the documents as spans of words. A window's words are compared as 32-bit codes, 20 in a row.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import doc_type, lean, materialise, release_memory

WINDOW, GRAM = 20, 8
#: Segments of a shard; shards with over twice as many are dealt over parts.
SHARD = 6000


def word_hashes(words):
    """The array of the 64-bit hashes of words (bytes). Hashing again is faster than looking words up."""
    import numpy as np
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def grams(hashes, n: int):
    """Hashes of all runs of ``n`` (8 or 16) word hashes."""
    import numpy as np

    out, size, factor = hashes, 1, 0x9E3779B97F4A7C15
    while size < n:
        out = out[:-size] * np.uint64(factor) + out[size:] if len(out) > size else out[:0]
        factor, size = factor * factor % 2**64, 2 * size
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(hashes):
    """(place, hash) arrays: for each window of 20 words the place and hash of its least 8-gram, the first of equals."""
    import numpy as np

    h = grams(hashes, GRAM)
    wide = WINDOW - GRAM + 1
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), h
    at, size = np.arange(len(h)), 1
    least = lambda a, b: np.where(h[a] <= h[b], a, b)
    while 2 * size <= wide:
        at, size = least(at[:-size], at[size:]), 2 * size
    at = least(at[:n], at[wide - size : wide - size + n])
    return at, h


def runs(values):
    """Where runs of equal values begin."""
    import numpy as np

    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _list_anchors(batches):
    """mapInArrow: (key, text) to the distinct anchors of each document and their segments there (2 if it stands at several places of one)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keys, found, places = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, h = anchors(word_hashes((text or "").encode().split()))
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            value, n = np.unique(h[at], return_counts=True)
            begins = runs(h[at])
            if len(begins) < len(at):
                n = np.maximum(np.unique(h[at[begins]], return_counts=True)[1], np.minimum(n, 2))
            found.append(value)
            places.append(n)
            keys.append(np.full(len(value), key, np.int64))
        if found:
            cols = (np.concatenate(keys), np.concatenate(found).view(np.int64), np.concatenate(places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "anchor", "n"])


def _compress(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if t is None else pack.compress(t.encode()) for t in text], pa.binary())],
                                         names=[*batch.schema.names[:-1], "z"])


def _unpack(z: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _segments(shards: int):
    """mapInArrow: (key, ord, z, anchors that recur) to segments: runs of windows with one anchor, as word codes.

    A run goes on over several places of the anchor, so a phrase said over and over is one segment.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, order, z, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = word_hashes(_unpack(z).split())
                at, gram = anchors(h)
                codes = (h >> np.uint64(32)).astype("<u4")
                edge = runs(gram[at])
                ends = np.append(edge[1:], len(at))
                anchor = gram[at[edge]]
                live = np.flatnonzero(np.isin(anchor, np.array(wanted, np.int64).view(np.uint64)))
                out[0] += (anchor[live].view(np.int64) % shards).tolist()
                out[1] += [key] * len(live)
                out[2] += [order] * len(live)
                out[3] += edge[live].tolist()
                out[4] += [codes[s : e + WINDOW - 1].tobytes() for s, e in zip(edge[live].tolist(), ends[live].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["shard", "key", "ord", "start", "codes"])

    return run


def _windows(codes: bytes):
    """The windows of a segment, each as the bytes of its codes."""
    step, size = 4, 4 * WINDOW
    return [codes[i : i + size] for i in range(0, len(codes) - size + 1, step)]


@contextmanager
def uncollected():
    """Without Python's cycle collector, which finds no cycles in millions of codes but walks them all."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _first_seen(table):
    """applyInArrow over a part of a large shard: each distinct window, its first document there and how often it stands there (2: or more)."""
    import pyarrow as pa

    first, times = {}, {}
    with uncollected():
        for order, codes in zip(table.column("ord").to_pylist(), table.column("codes").to_pylist()):
            for w in _windows(codes):
                first[w] = min(order, first.get(w, order))
                times[w] = min(2, times.get(w, 0) + 1)
    shard, part = table.column("shard")[0].as_py(), table.column("part")[0].as_py()
    return pa.table({"shard": pa.array([shard] * len(first), pa.int64()), "part": pa.array([part] * len(first), pa.int32()), "phrase": pa.array(list(first), pa.binary()),
                     "first": pa.array(list(first.values()), pa.int64()), "n": pa.array(list(times.values()), pa.int64())})


def dealt_phrases(found: DataFrame) -> DataFrame:
    """(shard, part, phrase, first): the phrases that recur in a large shard, at the parts that they stand in.

    ``found`` is (shard, part, phrase, first, n), a written table: a phrase has a row for each part that it stands in.
    """
    recur = found.groupBy("shard", "phrase").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where(F.col("n") > 1)
    return found.select("shard", "part", "phrase").join(recur.select("shard", "phrase", "first"), ["shard", "phrase"])


def _locate(segments, phrases):
    """cogroup of a shard's segments, or of a part of them, and the phrases of large shards that stand in it: spans to remove.

    Compiles the phrases and streams the segments. A window goes if its first document is an earlier one, or if it
    stands earlier in the same document; the latter is seen here only for windows of this shard, and equal windows
    are always of one shard.
    """
    import pyarrow as pa

    with uncollected():
        keys, begins, ends = _spans(segments, phrases)
    release_memory()
    return pa.table({"key": pa.array(keys, pa.int64()), "begin": pa.array(begins, pa.int64()), "end": pa.array(ends, pa.int64())})


def _spans(segments, phrases) -> tuple[list, list, list]:
    """Keys, begins and ends of the spans of :func:`_locate`."""
    import ahocorasick
    import numpy as np

    rows = list(zip(*(segments.column(c).to_pylist() for c in ("key", "ord", "start", "codes"))))
    first: dict[bytes, int] = {}
    if phrases.num_rows:
        first = dict(zip(phrases.column("phrase").to_pylist(), phrases.column("first").to_pylist()))
    else:
        once: dict[bytes, int] = {}
        for _, order, _, codes in rows:
            for w in _windows(codes):
                if w in first:
                    first[w] = min(first[w], order)
                elif w in once:
                    first[w] = min(once[w], order)
                else:
                    once[w] = order
        del once
    keys, begins, ends = [], [], []
    if first and rows:
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, f in first.items():
            machine.add_word(tuple(np.frombuffer(w, "<u4").tolist()), (f, w))
        if len(machine):
            machine.make_automaton()
            rows.sort(key=lambda r: (r[1], r[0], r[2]))
            held, seen = None, set()
            for key, order, start, codes in rows:
                if held != key:
                    held, seen = key, set()
                for end, (f, w) in machine.iter(tuple(np.frombuffer(codes, "<u4").tolist())):
                    s = start + end - WINDOW + 1
                    if f < order or w in seen:
                        if keys and keys[-1] == key and ends[-1] >= s:
                            ends[-1] = s + WINDOW
                        else:
                            keys.append(key)
                            begins.append(s)
                            ends.append(s + WINDOW)
                    seen.add(w)
        del machine
    return keys, begins, ends


def _kept(keep_text: bool):
    """mapInArrow: (doc, z, spans) to doc, n_words, n_removed, kept words' SHA-256 and, if asked for, the kept text."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _unpack(z)
                words = raw.split()
                out = words
                if spans and any(s["end"] < 0 for s in spans):
                    out = words if len(words) < WINDOW else []  # a copy: every word lies in a window that goes
                elif spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        gone[s["begin"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    out = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(out)
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                sha.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept.append(None if z is None else (joined if len(out) < len(words) else raw).decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The kept columns, n_words, n_removed and kept_sha256 of every row, and with ``keep_text`` the kept text.

    A word goes if it is covered by a window of 20 words that also starts earlier: in a document of smaller id (whole
    numbers; NULL: larger than all), or earlier in the same document. Rows with one id don't take words from each
    other, and equal rows get equal results. Texts of less than 20 words, empty and NULL texts lose nothing. A text that loses
    nothing is kept as it is, otherwise its kept words are joined by one space.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    key = F.xxhash64(id_col, text_col)
    text = F.col(text_col).cast("string")
    # Copies of a text of an earlier document lose all windows, whatever else there is; one document of each text goes on.
    light = docs.select(key.alias("key"), order.alias("ord"), F.xxhash64(text, F.lit(1)).alias("h1"), F.sha1(text.cast("binary")).alias("h2"))
    first = materialise(light.groupBy("h1", "h2").agg(F.min(F.struct("ord", "key")).alias("f")).select("h1", "h2", "f.ord", "f.key"))
    copies = light.join(first.select("h1", "h2", F.col("ord").alias("first_ord")), ["h1", "h2"]).where("ord > first_ord").select("key").distinct()
    listed = docs.select(key.alias("key"), text).mapInArrow(lean(_list_anchors), "key long, anchor long, n int")
    listed = materialise(listed.join(first.select("key"), "key", "left_semi").dropDuplicates(["key", "anchor"]))
    seen = listed.groupBy("anchor").agg(F.sum("n").alias("places")).where(F.col("places") > 1)
    live = materialise(listed.join(seen.select("anchor"), "anchor", "left_semi"))
    raw = docs.select(key.alias("key"), order.alias("ord"), F.struct(*keep).alias("doc"), text.alias("t"))
    packed = raw.mapInArrow(lean(_compress), f"key long, ord long, doc {doc_type(raw, 'doc')}, z binary")
    shards = max(1, -(-live.count() // SHARD))
    of = F.pmod("anchor", F.lit(shards))
    sizes = live.groupBy(of.alias("shard")).agg(F.sum("n").alias("n"))
    sizes = materialise(sizes.select("shard", F.when(F.col("n") > 2 * SHARD, F.ceil(F.col("n") / SHARD)).otherwise(F.lit(1)).cast("int").alias("parts")))

    def segments(anchors: DataFrame) -> DataFrame:
        wanted = anchors.groupBy("key").agg(F.collect_set("anchor").alias("wanted"))
        # Rows that repeat id and text are one document here.
        once = packed.select("key", "ord", "z").join(wanted, "key").dropDuplicates(["key"]).select("key", "ord", "z", "wanted")
        made = once.mapInArrow(lean(_segments(shards)), "shard long, key long, ord long, start long, codes binary").join(sizes, "shard")
        # By shard and part: the join alone would leave a large shard in one task.
        return made.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).repartition("shard", "part")

    large = live.withColumn("shard", of).join(sizes.where("parts > 1").select("shard"), "shard", "left_semi").drop("shard")
    large = segments(large).select("shard", "part", "ord", "codes").groupBy("shard", "part").applyInArrow(
        _first_seen, "shard long, part int, phrase binary, first long, n long")
    phrases = dealt_phrases(materialise(large))
    spans = (segments(live).select("shard", "part", "key", "ord", "start", "codes").groupBy("shard", "part")
             .cogroup(phrases.groupBy("shard", "part")).applyInArrow(_locate, "key long, begin long, end long"))
    spans = spans.unionByName(copies.select("key", F.lit(0).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end")))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    full = packed.select("key", "doc", "z").join(spans, "key", "left").select("doc", "z", "spans")
    schema = f"doc {doc_type(raw, 'doc')}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    out = full.mapInArrow(lean(_kept(keep_text)), schema)
    return out.select("doc.*", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, with their kept text and its length in ``chars_col``.

    A document that had words and lost all of them goes; all others stay.
    """
    held = docs.select(F.struct(*docs.columns).alias("doc_"), F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    held = held.withColumn("doc_", F.col("doc_").withField(text_col, F.lit(None).cast("string")))
    got = remove_repeats(held, ("doc_",), "id_", "text_", keep_text=True)
    got = got.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = {text_col: F.col("kept_text")}
    if chars_col in docs.columns:
        text[chars_col] = F.length("kept_text").cast(docs.schema[chars_col].dataType)
    return got.select(*[text.get(c, F.col("doc_")[c]).alias(c) for c in docs.columns])
