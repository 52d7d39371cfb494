import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertloom.llm import packing
from tests.llm.conftest import clash, doc_frame, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def truth(rows):
    tok = Tokenizer.from_file(PATH)
    return sorted((r.doc_id is None, r.doc_id or 0, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows)


def rebuilt(pieces):
    """Documents put together from their pieces, and the sequences' lengths."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens, p.source].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        assert len(p.ids) == 4 * p.length and 0 < p.length
    for got in by_seq.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(sum(n for _, n in x) < 2048 for x in by_seq.values()) <= 1
    return by_doc


@pytest.mark.parametrize("make", [lambda s, d: d, lambda s, d: clash(odd_docs(s))])
def test_every_id_lies_in_one_piece(spark, docs, make):
    df = make(spark, docs)
    pieces = packing.pack(df, PATH).collect()
    by_doc = rebuilt(pieces)
    got = []
    for (doc, n, _), parts in by_doc.items():
        parts.sort()
        flat = [i for _, ids in parts for i in ids]
        for k in range(len(flat) // n):  # repeated rows lie one behind the other only if they are alone
            pass
        got.append((doc, n, len(flat)))
    want = truth(df.collect())
    assert sum(n for *_, n in got) == sum(len(x) for *_, x in want)
    single = {d: x for _, d, x in want if [y for _, y, _ in want].count(d) == 1}
    for (doc, _, _), parts in by_doc.items():
        if doc in single and doc is not None:
            assert [i for _, ids in sorted(parts) for i in ids] == single[doc]
            at = 0
            for start, ids in sorted(parts):
                assert start == at
                at += len(ids)


def test_windows_follow_the_targets(spark):
    rows = [(i, f"w{i} alpha beta gamma " * 60, "en", "a" if i % 3 else "b") for i in range(300)]
    pieces = packing.pack(doc_frame(spark, rows), PATH).collect()
    total = sum(p.length for p in pieces)
    share = sum(p.length for p in pieces if p.source == "b") / total
    seqs = defaultdict(int)
    for p in pieces:
        if p.source == "b":
            seqs[p.sequence_id] += p.length
    last = max(p.sequence_id for p in pieces)
    for s in range(last):
        assert abs(seqs[s] - 2048 * share) <= 2 * 128


def test_weights_and_dry_queues(spark):
    rows = [(i, "one two three four five six seven " * 40, "en", "ab"[i % 2]) for i in range(80)]
    pieces = packing.pack(doc_frame(spark, rows), PATH, weights={"a": 3, "b": 1}).collect()
    rebuilt(pieces)
    first = [p for p in pieces if p.sequence_id == 0]
    assert abs(sum(p.length for p in first if p.source == "a") - 1536) <= 128
    last = [p for p in pieces if p.sequence_id == max(q.sequence_id for q in pieces)]
    assert {p.source for p in last} == {"b"}


def test_padded_sequences(spark, docs):
    pieces = packing.pack(docs.limit(20), PATH)
    for s in packing.sequences(pieces, pad_id=7).collect():
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == 2048 and (ids[s.n_tokens :] == 7).all()


def test_empty_and_crc(spark, docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0
    p = packing.pack(docs.limit(1), PATH).first()
    assert zlib.crc32(p.ids) == zlib.crc32(np.frombuffer(p.ids, "<u4").astype("<u4").tobytes())
