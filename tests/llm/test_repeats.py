import hashlib
import random

import pytest

from alertloom.llm import repeats
from tests.llm.conftest import clash, doc_frame, odd_docs


def brute(rows):
    """rows: (id, text). Documents of one id don't see each other; equal rows are one document."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first = {}
    for null, d, t in order:
        w = t.encode().split()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (null, d)), (null, d))
    out = []
    for d, t in rows:
        w, seen = (t or "").encode().split(), set()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if first[k] < (d is None, d or 0) or k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = [a for a, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def planted(spark):
    r = random.Random(1)
    passages = [[f"p{k}w{r.randrange(999)}" for _ in range(n)] for k, n in enumerate((19, 20, 21, 60, 200))]
    rows = []
    for i in range(120):
        words = [f"u{r.randrange(10**6)}" for _ in range(r.randrange(5, 90))]
        for p in r.sample(passages, r.randrange(3)):
            cut = r.randrange(len(p) // 3 + 1)
            at = r.randrange(len(words))
            words[at:at] = p[cut:]
        if i % 17 == 0:
            words += ["same"] * 50
        rows.append((i, "\n ".join(words), "en", "s"))
    rows.append((500, rows[3][1], "en", "s"))
    return doc_frame(spark, rows)


@pytest.mark.parametrize("make", [lambda s, d: d, lambda s, d: planted(s), lambda s, d: clash(odd_docs(s))])
def test_against_brute_force(spark, docs, make, monkeypatch):
    df = make(spark, docs)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df).collect()), key=str)
    assert got == want


def test_large_shards_are_dealt_over_parts(spark, monkeypatch):
    df = planted(spark)
    monkeypatch.setattr(repeats, "SHARD", 7)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_stripped_documents(spark):
    df = planted(spark)
    got = repeats.strip_repeats(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert 500 not in rows and 0 in rows  # a copy goes, the first stays
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert repeats.strip_repeats(df.limit(0)).count() == 0


def test_phrases_said_over_and_over_stay_few_segments(spark):
    import pyarrow as pa

    rows = [(i, " ".join(f"v{i}x{j}" for j in range(i)) + " spam eggs" * (40 + i) + " " + " ".join(f"k{j % 30}" for j in range(200)), "en", "s")
            for i in range(25)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(doc_frame(spark, rows)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])
    words = "spam eggs" + " spam eggs" * 500
    anchor = pa.Table.from_batches(repeats._list_anchors([pa.record_batch({"key": [1], "t": [words]})]))
    assert anchor.column("n").to_pylist() == [2]
    batch = pa.record_batch({"key": [1], "ord": [1], "z": pa.array([None], pa.binary()), "wanted": [anchor.column("anchor").to_pylist()]})
    packed = next(repeats._compress([pa.record_batch({"key": [1], "t": [words]})])).column("z")
    segments = pa.Table.from_batches(repeats._segments(3)([batch.set_column(2, "z", packed)]))
    assert segments.num_rows == 1 and len(segments.column("codes")[0].as_py()) == 4 * 1002


def test_parts_get_only_the_phrases_that_stand_in_them(spark):
    r = random.Random(4)
    found = {(r.randrange(2), r.randrange(9), bytes([r.randrange(60)])): (r.randrange(100), r.choice((1, 1, 2))) for _ in range(250)}
    df = spark.createDataFrame([(*k, *v) for k, v in found.items()], "shard long, part int, phrase binary, first long, n long")
    times, first = {}, {}
    for (shard, _, phrase), (f, n) in found.items():
        times[shard, phrase] = times.get((shard, phrase), 0) + n
        first[shard, phrase] = min(f, first.get((shard, phrase), f))
    want = sorted((s, p, w, first[s, w]) for s, p, w in found if times[s, w] > 1)
    got = sorted((x.shard, x.part, bytes(x.phrase), x.first) for x in repeats.dealt_phrases(df).collect())
    assert got == want


def test_word_hashes():
    import xxhash

    from alertloom.llm import repeats

    words = ["", "a", "caf\u00e9", *map(str, range(5000))]
    assert repeats.word_hashes([w.encode() for w in words]).tolist() == [xxhash.xxh64_intdigest(w.encode()) for w in words]
    assert not len(repeats.word_hashes([]))
