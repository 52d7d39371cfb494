"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of the tokens of its documents. In every round, one per window, a source's
deficit grows by its share of the window; it sends turns of ``turn`` tokens while the deficit lasts
and carries the rest to the next round. A source has received ``round * window * share`` tokens of
credit by then, so its turn j goes out in round ``ceil((j + 1) * turn / (window * share))``: all
deficits are known at every point of the stream, and the order of all turns (round, source, turn) is
made by sorting instead of by one loop. Prefix sums over blocks of rounds place every turn in the one
stream that is cut into windows, so deficits carry over windows and partitions alike. A source that
has run dry sends nothing and the others go on; only the last window is not full.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import doc_type, lean, materialise, rid_bucket, running_offsets, source_key, with_row_id, worker_cache

#: Rounds whose turns are put in order in one task.
ROUNDS = 16
#: Cache sizes of a worker, in entries; a full cache keeps what came first, as frequent words do.
CHUNKS, PIECES = 300_000, 200_000
#: Documents that are split together.
DOCS = 2048

# Fixed by the tokenizer file word_bpe_49k.json: how it splits lower-cased ASCII and Latin-1 letters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE uses for each byte: itself if printable, else the next from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def folded(text: str) -> str:
    """The text lower-cased, as the tokenizer would, if it is Latin-1 without special tokens; else as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def chunk_ids(path: str) -> Callable[[bytes], bytes]:
    """Function from a chunk of UTF-8 without ASCII white space to its ids as bytes ("<u4").

    No token of this tokenizer spans white space, so a text's ids are those of its chunks. Chunks of
    printable ASCII and Latin-1 letters are split here, where the tokenizer's normaliser only lower-cases
    them, and each part goes to its BPE model; all others go through the whole tokenizer.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, letters = tok.model, byte_letters()
    pieces = worker_cache(f"packing pieces {path}")
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]

    def piece(p: str) -> bytes:
        got = pieces.get(p)
        if got is None:
            text = p if p.isascii() else "".join(letters[b] for b in p.encode())
            got = np.array([t.id for t in model.tokenize(text)], "<u4").tobytes()
            if len(p) < 64 and len(pieces) < PIECES:
                pieces[p] = got
        return got

    def chunk(raw: bytes) -> bytes:
        s = raw.decode()
        if len(s) < 256 and _PLAIN.fullmatch(s) and not any(x in s for x in specials):
            return b"".join(map(piece, _PIECE.findall(s.lower())))
        return np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    return chunk


class Chunks(dict):
    """Ids of chunks as bytes; unknown ones are encoded, and kept while there is room."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = chunk_ids(path)

    def __missing__(self, raw: bytes) -> bytes:
        got = self.encode(raw)
        if len(raw) < 64 and len(self) < CHUNKS:
            self[raw] = got
        return got


def text_ids(texts: list, chunks: Chunks):
    """Ids of all texts behind each other, and where each text's begin; each distinct chunk is looked up once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pa.array([folded(t or "") for t in texts], pa.large_string()))
    parts = split.flatten().dictionary_encode()
    made = [chunks[raw] if raw else b"" for raw in parts.dictionary.cast(pa.large_binary()).to_pylist()]
    size = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat, begin, at = np.frombuffer(b"".join(made), "<u4"), np.cumsum(size) - size, parts.indices.to_numpy()
    n = size[at]
    off = np.cumsum(n) - n
    ids = flat[np.repeat(begin[at] - off, n) + np.arange(int(n.sum()))]
    return ids, np.append(0, np.cumsum(n))[split.offsets.to_numpy()]


def tokenise(docs: DataFrame, tokenizer_path: str, eos_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, sk, n and ids ("<u4" or, if every id fits, "<u2") of each document with the end id; NULL text is empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        made = worker_cache(f"packing chunks {tokenizer_path}")
        chunks = made.get("") or made.setdefault("", Chunks(tokenizer_path))
        for batch in batches:
            ids, counts = [], []
            for i in range(0, batch.num_rows, DOCS):
                found, cuts = text_ids(batch.column(2).slice(i, DOCS).to_pylist(), chunks)
                for j, k in zip(cuts, cuts[1:]):
                    all_ids = np.append(found[j:k], np.uint32(eos_id))
                    counts.append(len(all_ids))
                    ids.append((all_ids.astype("<u2") if all_ids.max() < 65536 else all_ids).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "sk", "n", "ids"])

    light = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("sk"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(lean(run), f"doc_id {doc_type(light, 'doc_id')}, sk string, n long, ids binary")


def _cut(window: int):
    """Cut a document's turns, already placed, at the ends of windows; turns that follow each other in both are one piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            doc, start, length, ids, sequence, offset = ([] for _ in range(6))
            for d, (n, raw, turns) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                tokens = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                runs: list[list[int]] = []
                for t in sorted(turns, key=lambda t: t["start"]):
                    if runs and runs[-1][2] + runs[-1][1] == t["pos"]:
                        runs[-1][1] += t["len"]
                    else:
                        runs.append([t["start"], t["len"], t["pos"]])
                for at, left, pos in runs:
                    while left:
                        size = min(left, window - pos % window)
                        doc.append(d)
                        start.append(at)
                        length.append(size)
                        ids.append(tokens[4 * at : 4 * (at + size)])
                        sequence.append(pos // window)
                        offset.append(pos % window)
                        at, left, pos = at + size, left - size, pos + size
            at = pa.array(doc, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, sequence, offset)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(4).take(at), batch.column(1).take(at), *numbers, pa.array(ids, pa.binary())],
                                             names=["doc_id", "sk", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, turn: int = 128, eos_id: int = 1, weights: Mapping[str | None, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents into windows of ``window`` tokens: a row per piece.

    Columns: doc_id, source, start (ids of the document before the piece), length, ids ("<u4" bytes),
    doc_tokens, sequence_id, offset. ``weights`` gives the share of each source (others: weight 0, packed
    after all weighted ones); without it the shares are the sources' shares of all tokens, so that all queues
    run dry together. NULL text is empty and has the end id alone; NULL sources are one source; repeated
    rows are packed once each; an empty table gives no pieces.
    """
    tokens = materialise(with_row_id(tokenise(docs, tokenizer_path, eos_id, id_col, text_col, source_col)))
    light = tokens.select("rid", "sk", "n").withColumn("_b", rid_bucket())
    queues = light.groupBy("sk").agg(F.sum("n").alias("queue"))
    placed = running_offsets(light, ["sk"], "_b", ["rid"], "n", "off")
    if weights is None:
        total = light.agg(F.sum("n")).first()[0] or 1
        queues = queues.withColumn("share", F.col("queue") / F.lit(float(total)))
    else:
        whole = float(sum(weights.values()))
        given = [F.when(F.col("sk") == ("1" if s is None else f"0{s}"), F.lit(w / whole)) for s, w in weights.items()]
        queues = queues.withColumn("share", F.coalesce(*given, F.lit(0.0)))
    placed = placed.join(queues.select("sk", "share"), "sk")
    first, last = F.floor(F.col("off") / turn), F.floor((F.col("off") + F.col("n") - 1) / turn)
    turns = placed.withColumn("j", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("off"), F.col("j") * turn)
    # Weight 0: after every weighted turn, in rounds of their own.
    at = F.when(F.col("share") > 0, F.ceil((F.col("j") + 1) * float(turn) / (float(window) * F.col("share")))).otherwise(F.lit(2**60) + F.col("j"))
    turns = turns.select("rid", "sk", (begin - F.col("off")).alias("start"), (F.least(F.col("off") + F.col("n"), (F.col("j") + 1) * turn) - begin).alias("len"),
                         at.alias("round"), "j")
    turns = turns.withColumn("_b", F.floor(F.col("round") / ROUNDS))
    turns = running_offsets(turns, [], "_b", ["round", "sk", "j", "rid"], "len", "pos")
    placed_turns = turns.groupBy("rid").agg(F.collect_list(F.struct("start", "len", "pos")).alias("turns"))
    full = tokens.join(placed_turns, "rid").select("doc_id", "n", "ids", "turns", "sk")
    kind = doc_type(full, "doc_id")
    pieces = full.mapInArrow(lean(_cut(window)), f"doc_id {kind}, sk string, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")
    source = F.when(F.col("sk") != "1", F.expr("substring(sk, 2)"))
    return pieces.select("doc_id", source.alias("source"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens and ids, padded to the window, as "<u4" bytes."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(
        ordered, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    fill = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({window} - n_tokens as int))"))
    return joined.withColumn("ids", F.concat("ids", fill))
