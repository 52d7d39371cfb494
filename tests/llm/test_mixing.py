import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from alertloom.llm import mixing
from tests.llm.conftest import clash, doc_frame, odd_docs

W = (5.0, 2.0, 1.0)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("make", [lambda s, d: d, lambda s, d: clash(odd_docs(s))])
def test_plan(spark, docs, make):
    df = make(spark, docs)
    got = mixing.mix_plan(mixing.sized_rows(df, keep=("doc_id", "source")), W, block=8).collect()
    want = [(r.doc_id, len((r.text or "").encode().split())) for r in df.collect()]
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(want, key=str)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * 8 + 8, (s, taken[s], target[s])


def test_reruns_agree_and_seed_matters(spark, docs):
    rows = mixing.sized_rows(docs.limit(60))
    take = lambda seed: {(r.doc_id, r.taken) for r in mixing.mix_plan(rows, W, seed=seed).collect()}
    assert take(1) == take(1) != take(2)


def test_apportion_against_one_seat_at_a_time(spark):
    r = random.Random(3)
    for seats in (0, 1, 7, 40, 333):
        votes = {f"p{i:02}": r.choice([0, 1, 5, 5, 90, 400]) * r.random() for i in range(12)}
        whole = sum(votes.values()) or 1
        cap = {p: max(1, int(seats * v / whole + r.choice([0, 1, 50]))) for p, v in votes.items()}
        got = {}
        if sum(v for v in votes.values()):
            won = dict.fromkeys(votes, 0)
            for _ in range(seats):
                p = min((p for p in won if won[p] < cap[p] and votes[p]), key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
                won[p] += 1
            df = spark.createDataFrame([("g", p, float(v), seats, cap[p]) for p, v in votes.items()], "g string, p string, v double, s long, c long")
            got = {x.p: x.got for x in mixing.apportion(df, ["g"], "p", "v", "s", "c").collect()}
            assert got == won


def test_documents_hold_what_the_plan_takes(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(5 + 7 * i)), "en", "abcd"[i % 4]) for i in range(40)] + [(90, "", "en", "a"), (91, None, "en", None)]
    df = doc_frame(spark, rows).withColumn("extra", F.lit(1))
    mixed = mixing.mix_documents(df, W, block=8)
    assert mixed.columns == df.columns
    held = defaultdict(int)
    copies = defaultdict(list)
    for r in mixed.collect():
        held[r.doc_id] += len((r.text or "").split())
        copies[r.doc_id].append(r.text)
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(mixing.sized_rows(df), W, block=8).collect()}
    assert {d: n for d, n in held.items() if n} == {d: n for d, n in plan.items() if n}
    for i, text, *_ in rows:
        for got in copies[i]:
            if text:
                it = iter(text.split())
                assert all(w in it for w in got.split())  # in order, each at most once in a copy
    assert copies[90] == [""] and copies[91] == [None]
    assert mixing.mix_documents(df.limit(0), W).count() == 0
