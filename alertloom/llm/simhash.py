"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are two blocks of 23 and a rest of 18. The binary Golay code covers 23 bits
with radius 3: each block has one anchor (codeword) within 3 bits. The anchors of a fingerprint are
pairs of codewords; its home is the pair nearest to it. A fingerprint within ``t`` bits of another
lies, block by block, within 3 + e1 and 3 + e2 bits of the other's home with e1 + e2 <= t, so
replicating it to all such pairs brings it to that home. Per anchor, those at home are compared with
all that came, over the whole 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import doc_type, lean, materialise
from alertloom.session import cut_lineage

BLOCK, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code of length 23 (a fixed value of that code).
GOLAY = 0b101011100011
#: Fingerprints at one anchor that are compared in one task; larger groups are dealt over salts.
GROUP = 4096


def fingerprint_rows(shingle: int):
    """mapInArrow function: (id, text, key) to (id, key, fp), the fingerprint as a signed 64-bit number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for r, text in enumerate(batch.column(1).to_pylist()):
                parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
                if not parts:
                    continue
                line = b" ".join(parts)
                ends, at = [], 0
                for w in parts:
                    at += len(w) + 1
                    ends.append(at - 1)
                starts = [0, *[e + 1 for e in ends]]
                k = min(shingle, len(parts))
                hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], np.uint64, len(parts) - k + 1)
                # Bits of many hashes at a time, so that a long text takes little memory.
                votes = np.zeros(64, np.int64)
                for i in range(0, len(hashes), 65536):
                    votes += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fps[r] = np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["id", "key", "fp"])

    return run


def row_key(id_col: str, text_col: str):
    """Hash of id and text: equal rows, and only they, share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp) of every row: SimHash of the shingles of ``shingle`` words, repeats counted.

    Words are split at ASCII white space, A-Z are lower-cased. A bit is 1 if it is set in over half of the
    shingles' XXH64 (seed 42). Texts with fewer words have one shingle, all their words; NULL and empty
    texts have fingerprint 0. ``key`` is ``row_key``.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("key"))
    return light.mapInArrow(lean(fingerprint_rows(shingle)), f"id {doc_type(light, 'id')}, key long, fp long")


def golay_table():
    """For each 23-bit word its syndrome's coset leader gives the anchor: an array syndrome -> error pattern."""
    import numpy as np
    from itertools import combinations

    patterns = np.array([0, *(sum(1 << i for i in c) for k in range(1, RADIUS + 1) for c in combinations(range(BLOCK), k))], np.int64)
    leaders = np.full(1 << 11, -1, np.int64)
    leaders[syndromes(patterns)] = patterns
    assert (leaders >= 0).all()  # the code is perfect: every word is within 3 bits of one codeword
    return leaders


def syndromes(x):
    """Remainders of 23-bit words modulo the generator polynomial."""
    import numpy as np

    x = np.array(x, np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


def near_codewords(words, leaders, threshold: int):
    """Codewords within 3 + e bits of each word, for e up to ``threshold``: arrays (index of word, codeword, e).

    Found from the word with every set of up to ``threshold`` bits flipped: a codeword at distance 3 + e is
    within 3 of such a word.
    """
    import numpy as np
    from itertools import combinations

    flips = np.array([0, *(sum(1 << i for i in c) for k in range(1, threshold + 1) for c in combinations(range(BLOCK), k))], np.int64)
    words = np.asarray(words, np.int64)
    at, code = np.repeat(np.arange(len(words)), len(flips)), (words[:, None] ^ flips[None, :]).ravel()
    code = code ^ leaders[syndromes(code)]
    both = np.unique((at << BLOCK) | code)
    at, code = both >> BLOCK, both & ((1 << BLOCK) - 1)
    extra = np.maximum(np.bitwise_count(code ^ words[at]).astype(np.int64) - RADIUS, 0)
    keep = extra <= threshold
    return at[keep], code[keep], extra[keep]


def _replicate(threshold: int):
    """mapInArrow: distinct fp to (anchor, fp, home) for every anchor that has to see it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        leaders = golay_table()
        mask = (1 << BLOCK) - 1
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                a1, c1, e1 = near_codewords(fp & mask, leaders, threshold)
                a2, c2, e2 = near_codewords((fp >> BLOCK) & mask, leaders, threshold)
                first2 = np.searchsorted(a2, np.arange(len(fp) + 1))
                # Pair each codeword of block 1 with those of block 2 of the same fingerprint.
                n2 = (first2[1:] - first2[:-1])[a1]
                left = np.repeat(np.arange(len(a1)), n2)
                right = np.arange(n2.sum()) - np.repeat(np.cumsum(n2) - n2, n2) + first2[a1][left]
                ok = e1[left] + e2[right] <= threshold
                left, right = left[ok], right[ok]
                yield pa.RecordBatch.from_arrays([pa.array((c1[left] << BLOCK) | c2[right]), pa.array(fp[a1[left]]),
                                                  pa.array((e1[left] == 0) & (e2[right] == 0))], names=["anchor", "fp", "home"])

    return run


def _links(threshold: int):
    """applyInArrow: links of one anchor group, thinned to a spanning forest of what the group connects."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)
        parent = np.arange(len(fp))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a, b = [], []
        for i in np.flatnonzero(home):
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= threshold):
                x, y = root(i), root(j)
                if x != y:
                    parent[x] = y
                    a.append(fp[i])
                    b.append(fp[j])
        ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    return run


def links(distinct: DataFrame, threshold: int = 2, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in 1 .. ``threshold`` bits.

    The links connect what all links of their anchors connect, without listing every pair. An anchor where more
    than ``group`` fingerprints meet is dealt over salts: those at home are split, the others go to each part.
    """
    at = distinct.select("fp").mapInArrow(lean(_replicate(threshold)), "anchor long, fp long, home boolean")
    at = materialise(at)
    sizes = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes"))
    busy = sizes.where((F.col("homes") > 0) & (F.col("n") > 1)).select("anchor", F.ceil(F.col("n") / group).cast("int").alias("parts"))
    at = at.join(busy, "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (F.col("part") == own))
    # By anchor and part: the join alone would leave a large anchor in one task.
    dealt = dealt.select("anchor", "part", "fp", "home").repartition("anchor", "part")
    return dealt.groupBy("anchor", "part").applyInArrow(_links(threshold), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps: each step only aggregates and joins by node, and a checkpoint cuts
    the lineage. Rounds grow with the logarithm of the longest path. Raises RuntimeError if they don't settle.
    """
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(most_rounds):
        # Large-star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        near = both(e).toDF("u", "v")
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: every smaller neighbour, and the node, are linked to the smallest.
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("s"))
        e = cut_lineage(e.select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            return e.toDF("node", "root")
        sign = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, root, component_id) of every row: the smallest id reachable over fingerprints that differ in up to
    ``threshold`` bits, and ``root``, a fingerprint that names the component.

    Equal fingerprints are one node, so exact copies meet as counts and minima only. Rows with a NULL id take part
    and never name a component unless all its ids are NULL. Repeated rows stay. An empty table gives no rows.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("threshold must be 0 to 4 bits")
    rows = materialise(fingerprints(docs, shingle, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    if threshold:
        nodes = nodes.join(components(links(nodes, threshold)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    else:
        nodes = nodes.withColumn("root", F.col("fp"))
    nodes = materialise(nodes)
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("fp", "root").join(lows, "root")
    return rows.join(named, "fp").select("id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one whose id names it.

    Of rows with that id the one with the smallest hash of id and text stays, once if it is repeated; a group
    whose ids are all NULL keeps one row.
    """
    found = near_duplicates(docs, shingle, threshold, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), row_key(id_col, text_col).alias("key"))
    return rows.join(best, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
