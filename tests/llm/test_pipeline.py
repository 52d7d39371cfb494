import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from alertloom.llm import queries, toxicity
from tests.llm.conftest import SF, clash, doc_frame
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    df = docs
    for i, (_, stage) in enumerate(P.STAGES):
        df = stage(spark, df, SF)
        if i < len(P.STAGES) - 1:
            assert df.dtypes == docs.dtypes
            df = P.materialise(df)
        seen.append(df.count())
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "repeats", "mixing", "packing"]
    assert seen[0] > seen[1] > seen[2] >= seen[3] and seen[1] > 0.8 * seen[0]
    by_seq = defaultdict(int)
    for r in df.collect():
        by_seq[r.sequence_id] += r.length
    assert sum(n < 2048 for n in by_seq.values()) <= 1


def test_stages_on_few_rows(spark):
    for rows in ([], [(1, None, None, None)], [(1, "", "en", "s"), (1, "", "en", "s")]):
        df = doc_frame(spark, rows)
        for _, stage in P.STAGES:
            df = P.materialise(stage(spark, df, SF))
        assert df.count() == (1 if rows else 0)


def fixture(spark, folder):
    """A table directory with planted toxic, copied, near, repeated, NULL, empty and long rows."""
    import random
    r = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "del", "vos", "pin") for c in ("", "sen", "tor", "mal", "gi")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bad = lambda n: " ".join(r.choice(["filthscum", "vermint", r.choice(vocabulary), r.choice(vocabulary)]) for _ in range(n))
    rows = [(i, bad(60) if i % 6 == 0 else text(60), "en", f"s{i % 3}") for i in range(180)]
    passage = text(30)
    rows += [(200, rows[1][1], "en", "s1"), (201, rows[1][1], "en", "s1"), (201, rows[1][1], "en", "s1"), (202, rows[2][1], "de", None)]
    rows += [(203 + i, f"{text(40)} {passage} {text(20 + i)}", "en", "s0") for i in range(5)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n ", "en", "s1"), (None, text(50), "en", "s2"), (303, " ".join(r.choice(vocabulary) for _ in range(9000)), "en", "s2"),
             (304, bad(80), "en", "s2"), (305, bad(80), None, None)]
    df = doc_frame(spark, rows)
    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), {*range(0, 180, 6), 304, 305}


def test_run_against_plain_python(spark, tmp_path, monkeypatch):
    docs, toxic = fixture(spark, str(tmp_path))
    seen = []
    kept = P.materialise
    monkeypatch.setattr(P, "materialise", lambda df: seen.append(kept(df)) or seen[-1])
    pieces = P.run(spark, str(tmp_path)).collect()
    by_stage = [[(r.doc_id, r.text, r.source) for r in df.collect()] for df in (docs, *seen)]
    for df in seen:
        assert df.dtypes == docs.dtypes
    # Toxicity: the rows whose plain score, under the fitted model, is below 0.5; that is all clean and no toxic ones.
    effects, bias = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), queries.fold(5) != 0)

    def low(text):
        ids, share = toxicity.bag(text)
        return 1 / (1 + math.exp(-(float(share @ effects[ids]) + bias))) < 0.5

    key = lambda rows: sorted(rows, key=str)
    assert key(by_stage[1]) == key(x for x in by_stage[0] if low(x[1])) == key(x for x in by_stage[0] if x[0] not in toxic)
    # Near duplicates: the smallest id of each group of linked fingerprints.
    fps = [brute_fp(t) for _, t, _ in by_stage[1]]
    groups = defaultdict(list)
    for root, row in zip(brute_components(fps, 2), by_stage[1]):
        groups[root].append(row)
    assert key(by_stage[2]) == key(min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values())
    assert {1, 2, 200, 201, 202} & {x[0] for x in by_stage[2]} == {1, 2}
    # Repeats: the words that plain removal keeps; documents that lose all of theirs go.
    plain = {d: (n, gone, sha) for d, n, gone, sha in brute_repeats([x[:2] for x in by_stage[2]])}
    left = {x[0]: x[1] for x in by_stage[3]}
    assert left.keys() == {d for d, (n, gone, _) in plain.items() if not n or gone < n}
    for d, text in left.items():
        assert hashlib.sha256((text or "").encode()).hexdigest() == plain[d][2]
    assert sum(gone > 0 for _, gone, _ in plain.values()) == 4
    # Mixing: no document more often than three times.
    times = Counter(x[0] for x in by_stage[4])
    assert max(times.values()) <= 3 and times.keys() <= left.keys()
    # Packing: every id of every copy in one piece, all windows but one full.
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tok.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in by_stage[4])
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert sum(p.length for p in pieces) == want and sum(sum(n for _, n in s) < 2048 for s in by_seq.values()) <= 1
    for s in by_seq.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and min(s)[0] == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs, _ = fixture(spark, str(tmp_path))
    wide = clash(docs)
    for name, stage in P.STAGES[:4]:
        out = stage(spark, wide, str(tmp_path))
        assert set(out.columns) == set(wide.columns) and out.select("at", "words").distinct().collect() == [("z", "z")], name
