import inspect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import classlm, langid, quality, queries, toxicity
from alertloom.llm.bags import letter_words
from alertloom.llm.common import words
from tests.llm.conftest import SF, clash, doc_frame, odd_docs


# ---------------------------------------------------------------- quality rules

def brute_rules(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.mark.parametrize("make", [lambda s, d: d, lambda s, d: clash(odd_docs(s))])
def test_base_rules(spark, docs, make):
    df = make(spark, docs)
    got = quality.base_rules(df.withColumn("_words", words("text"))).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text)


def test_ratio_is_the_mean_of_log_ratios(spark):
    texts = {1: "good clean words here", 2: "good words", 3: "bad junk ### junk", 4: None, 5: ""}
    df = doc_frame(spark, [(i, t, "en", "s") for i, t in texts.items()])
    good = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")
    ratio = quality.fit_ratio(df, good, buckets=64)
    b = {r.doc_id: r.b for r in df.select("doc_id", quality.ngram_buckets(words("text"), buckets=64).alias("b")).collect()}
    assert [len(b[i]) for i in texts] == [7, 3, 7, 0, 0]
    every, trusted = Counter(x for v in b.values() for x in v), Counter(b[1] + b[2])
    for k in range(64):
        want = math.log((trusted[k] + 1) / (sum(trusted.values()) + 64)) - math.log((every[k] + 1) / (sum(every.values()) + 64))
        assert ratio[k] == pytest.approx(want)
    got = {r.doc_id: r for r in quality.judge(df, ratio, 0.0).collect()}
    for i, v in b.items():
        assert got[i].quality_score == (pytest.approx(sum(ratio[x] for x in v) / len(v)) if v else None)
        assert not got[i].kept  # fewer than 50 words
    assert quality.judge(df.limit(0), ratio).count() == 0
    assert got[1].quality_score > got[3].quality_score


def test_judged_rows_keep_their_columns(spark):
    df = odd_docs(spark).withColumns({n: F.lit(n) for n in ("_words", "row", "_id", "_text", "w", "b")})
    got = quality.judge(df, [0.0] * 64)
    assert got.columns[: len(df.columns)] == df.columns and all(r["_words"] == "_words" and r["row"] == "row" for r in got.collect())
    with pytest.raises(ValueError):
        quality.judge(df.withColumn("kept", F.lit(1)), [0.0] * 64)


def test_query_keeps_good_documents(spark):
    got = queries.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert right >= 0.95 * len(got)


# ---------------------------------------------------------------- class language model

@pytest.mark.parametrize("together", [7, 2048])
def test_language_model(spark, docs, monkeypatch, together):
    monkeypatch.setattr(classlm, "DOCS", together)
    monkeypatch.setattr(classlm, "HELD_WORDS", 50)  # most words meet their counts in the join
    df = docs.unionByName(odd_docs(spark))
    train = df.where(queries.fold(10) != 0)
    model = classlm.fit(train)
    counts = Counter()
    for r in train.collect():
        counts.update([*(r.text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (n, v)
    assert model.least > 1
    k_of, c_of = ({r.id: r[x] for r in model.counts.collect()} for x in ("k", "c"))
    cls = {w: k_of[classlm.word_id(w)] if w else classlm.CLASSES for w in counts}
    assert all(c_of[classlm.word_id(w)] == c for w, c in counts.items() if w)

    def p_base(w):
        return (counts[w] + 0.1) / (n + 0.1 * (v + 1))

    def p_model(before, w):
        k = cls[w] if w in cls else int(model.ending_class[classlm.word_id(w) % classlm.ENDINGS])
        emit = 1.0 if not w else (counts[w] + 0.1) / model.emission_sizes[k]
        return 0.9 * model.transitions[before, k] * emit + 0.1 * p_base(w), k

    # A distribution over all seen words, the end and one unseen word of each class.
    sizes = Counter(cls.values())
    for k in range(classlm.CLASSES):
        total = sum(counts[w] + 0.1 for w in cls if w and cls[w] == k) + 0.1
        if sizes[k]:
            assert total == pytest.approx(model.emission_sizes[k])
    assert model.transitions.sum(1) == pytest.approx(np.ones(classlm.CLASSES + 1))
    rows = df.select("doc_id", "text").collect()
    want = []
    for r in rows:
        before, base, score, known, tokens = classlm.CLASSES, 0.0, 0.0, 0, [*(r.text or "").encode().lower().split(), b""]
        for w in tokens:
            p, before = p_model(before, w)
            score, base, known = score + math.log10(p), base + math.log10(p_base(w)), known + (counts[w] > 0)
        want.append((r.doc_id, len(tokens), known, round(base, 4), round(score, 4)))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in classlm.score(clash(df), model).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("held", [30, 1000])
def test_every_word_has_a_class_of_its_neighbours(spark, monkeypatch, held):
    monkeypatch.setattr(classlm, "UNIT_WORDS", 8)
    monkeypatch.setattr(classlm, "HELD_WORDS", held)  # with 30, classes of most words are joined
    monkeypatch.setattr(classlm, "COUNTED", 500)
    r = random.Random(3)
    # Words of two kinds that take turns; all end alike, so their endings tell nothing.
    kinds = [[f"{a}{i}xyz" for i in range(60)] for a in "pq"]
    texts = [" ".join(r.choice(kinds[j % 2]) for j in range(40)) for _ in range(150)]
    model = classlm.fit(doc_frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    by_id = {x.id: x.k for x in model.counts.collect()}
    k = {w: by_id[classlm.word_id(w.encode())] for kind in kinds for w in kind}
    assert len(by_id) == 120 and {k[w] for w in kinds[0]}.isdisjoint(k[w] for w in kinds[1])
    both = Counter()
    for t in texts:
        c = [classlm.CLASSES, *(k[w] for w in t.split()), classlm.CLASSES]
        both.update(zip(c, c[1:]))
    both[classlm.CLASSES, classlm.CLASSES] = 0
    want = np.array([[both[i, j] + 0.1 for j in range(classlm.CLASSES + 1)] for i in range(classlm.CLASSES + 1)])
    assert model.transitions == pytest.approx(want / want.sum(1, keepdims=True))


def test_exchange_finds_the_classes(spark):
    r, n = np.random.default_rng(0), 30
    pairs = np.zeros((n + 1, n + 1))
    at = 0
    for _ in range(30_000):  # words of class 0 are followed by class 1, 1 by 2, 2 by 0
        new = 3 * r.integers(10) + (at % 3 + 1) % 3
        pairs[at, new] += 1
        at = new
    cls = classlm.exchange(pairs, 3)
    assert cls[n] == 3 and all(len({cls[i] for i in range(k, n, 3)}) == 1 for k in range(3)) and len(set(cls[:n])) == 3


def test_empty_language_model(spark, docs):
    model = classlm.fit(docs.limit(0))
    assert classlm.score(docs.limit(0), model).count() == 0
    r = classlm.score(docs.limit(1), model).first()
    assert r.n_known == 0 and math.isfinite(r.score)


# ---------------------------------------------------------------- language and toxicity

def test_language_held_out(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_langid(spark, SF).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, docs):
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(clash(odd_docs(spark)), model).collect()
    text = {r.doc_id: r.text for r in odd_docs(spark).collect()}
    for r in got:
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(docs.limit(3), langid.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}
    # An unseen word takes the language of its n-grams.
    known = doc_frame(spark, [(1, "straße größe weiß groß", "de", "s"), (2, "niño año señor mañana", "es", "s")])
    unseen = doc_frame(spark, [(1, "größer", None, None), (2, "señora", None, None)])
    assert [r.lang_pred for r in langid.identify(unseen, langid.fit(known, F.lit(True))).orderBy("doc_id").collect()] == ["de", "es"]


def test_whole_texts_have_the_language_of_their_summed_words(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark))
    model = langid.fit(df, queries.fold(3) != 1, per_lang=20)
    for r in langid.identify(clash(df), model, ("doc_id", "text")).collect():
        words_of = letter_words(r.text)
        if not words_of:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [sum(n * langid.word_scores(w, model)[i] for w, n in words_of.items()) for i in range(len(model[0]))] if sum(map(len, words_of)) < 3000 else None
        if total:
            best = max(total)
            assert r.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), abs=1e-6)
            assert r.lang_pred == model[0][total.index(best)] or sorted(total)[-2] > best - 1e-6


def test_small_languages_keep_all_their_words(spark):
    big = " ".join(f"{a}{b}{c}{d}{e}" * 2 for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl" for d in "abcdefghijkl" for e in "abcdefghij")
    rows = [(1, f"{big} {big}", "aa", "s"), (2, "zoom zest zulu", "zz", "s"), (3, "yoke yarn zulu", "yy", "s")]
    model = langid.fit(doc_frame(spark, rows), F.lit(True))
    assert model[0] == ["aa", "yy", "zz"]
    test = doc_frame(spark, [(1, "zoom zest", None, None), (2, "yoke yarn", None, None), (3, "zoo", None, None)])
    assert [r.lang_pred for r in langid.identify(test, model).orderBy("doc_id").collect()] == ["zz", "yy", "zz"]


def test_language_scores_against_brute_force(spark, docs):
    model = langid.fit(docs, F.lit(True))
    sample = {(r.doc_id, r.text): r for r in docs.where("lang is not null and text is not null").collect()}
    langs = sorted({r.lang for r in sample.values()})
    tables = [{} for _ in range(5)]
    for r in sample.values():
        for w, n in langid.letter_words(r.text).items():
            for size in range(5):
                for g in langid.grams(w, size) if size else [w]:
                    tables[size].setdefault(g, Counter())[r.lang] += n

    def mean(size, keys):
        t = tables[size]
        total = [sum(c[x] for c in t.values()) + 0.5 * (len(t) + 1) for x in langs]
        found = [[math.log((t[g][x] + 0.5) / y) for x, y in zip(langs, total)] for g in keys if g in t]
        return [sum(x) / len(found) for x in zip(*found)] if found else None

    r = random.Random(2)
    known = r.sample(sorted(tables[0]), 40)
    for w in known + [x[::-1] for x in known] + ["ж", "qqqq"]:
        want = mean(0, [w]) or next((m for n in (4, 3, 2, 1) if (m := mean(n, langid.grams(w, n)))), [0.0] * len(langs))
        assert langid.word_scores(w, model) == pytest.approx(want)


def test_toxicity_finds_misspellings(spark):
    r = random.Random(0)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "del", "vos", "pin", "sun")]
    make = lambda bad: " ".join(bad if r.random() < 0.05 else r.choice(plain) for _ in range(200))
    rows = [(i, make("idiotic" if i % 3 else "stupid") if i % 4 == 0 else make("karan"), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    df = doc_frame(spark, rows)
    model = toxicity.fit(df, labels, F.lit(True), per_label=150)
    test = doc_frame(spark, [(1, make("idiotik"), "en", "s"), (2, make("stuppid"), "en", "s"), (3, make("loran"), "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, "1 2", "x", "y")])
    got = {x.doc_id: x.score for x in toxicity.score(clash(test), model).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.5 and got[4] == got[5] == got[6] and 0 <= got[4] <= 1
    kept = toxicity.drop_toxic(clash(test), model)
    assert kept.columns == clash(test).columns and {1, 2}.isdisjoint(x.doc_id for x in kept.collect())
    assert toxicity.score(df, toxicity.fit(df, labels.limit(0), F.lit(True))).where("score > 0.5").count() == 0


def test_toxicity_learns_from_4000_documents_of_a_label(spark):
    rows = [(i, f"word{i}", "en", "s") for i in range(6500)] + [(0, "a", "en", "s"), (0, "zzz", "en", "s")]
    labels = spark.createDataFrame([(i, int(i < 2500)) for i in range(6500)] * 2 + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(doc_frame(spark, rows), labels, F.lit(True), inspect.signature(toxicity.fit).parameters["per_label"].default, "doc_id", "text", "toxic").collect()
    assert Counter(r.toxic for r in got) == {0: 4000, 1: 2500} and next(r._text for r in got if r._id == 0) == "a"


def test_toxicity_weighs_buckets_by_all_documents(spark):
    df = clash(odd_docs(spark)).repartition(3)
    bags = [set(toxicity.bag(r.text)[0].tolist()) for r in df.select("text").collect()]
    want = [30 * math.log((len(bags) + 1) / (sum(b in x for x in bags) + 1)) for b in range(toxicity.BUCKETS)]
    assert toxicity.rarity(df) == pytest.approx(np.array(want))
    assert not toxicity.rarity(df.limit(0)).any()


def test_toxicity_scores_equal_the_plain_average(spark):
    effects, bias = np.random.default_rng(3).normal(0, 3, toxicity.BUCKETS), -0.5
    df = clash(odd_docs(spark))
    got = toxicity.score(df, (effects, bias), ("doc_id", "text")).collect()
    assert len(got) == df.count()
    for r in got:
        ids, share = toxicity.bag(r.text)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(float(share @ effects[ids]) + bias))), rel=1e-9)


def test_letters_are_letters_only(spark):
    assert letter_words("\u00bd \u00b2 \u2460 7_ \u2167") == Counter() and letter_words(None) == Counter()
    assert letter_words("Ab\u00b2c \u4e2d\u6587x ab") == {"ab": 2, "c": 1, "\u4e2d\u6587x": 1}
    model = langid.fit(doc_frame(spark, [(1, "hallo welt", "de", "s")]), F.lit(True))
    got = langid.identify(doc_frame(spark, [(1, "\u00bd \u00b2", "de", "s"), (2, "welt", "de", "s")]), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0), ("de", 1.0)]


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > 0.75
    assert sum(b >= 0.5 for b in neg) <= 0.08 * len(neg)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
