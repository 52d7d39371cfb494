"""The registered queries of the training-data operators, their SQL and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.llm import classlm, goodness, langid, mixing, negatives, packing, quality, repeats, sharding, simhash, topk, toxicity, whitening
from alertloom.llm.common import WORD


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int):
    """Remainder of crc32(doc_id as text); a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op1_packing(spark, sf_dir):
    """All documents packed into windows of 2,048 tokens; the sources' shares of all tokens are the targets."""
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


#: Mean log ratio from which a document is kept: no more than this below a text as common in both corpora.
QUALITY_THRESHOLD = -0.05


def op2_quality(spark, sf_dir):
    """Base rules and the verdict of the hashed n-gram ratio of documents labelled good against all."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit_ratio(docs, _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
    return quality.judge(docs, ratio, QUALITY_THRESHOLD).drop("text")


def op3_classlm(spark, sf_dir):
    """Log probability of all documents under a class bigram model of those whose crc32 mod 10 is not 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classlm.fit(docs.where(fold(10) != 0))
    scored = classlm.score(docs, model)
    return scored.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")


def op4_sharding(spark, sf_dir):
    """All documents in 16 equal shards of a tree of 2 regions and 4 racks; ``grown_shard``: with shard 16 in a region of its own."""
    tree = sharding.balanced_tree(16)
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                                                     F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = sharding.shard_rows(docs, "doc_id", tree)
    rows = sharding.shard_rows(rows, "doc_id", sharding.grow(tree), "grown_shard")
    rows = sharding.number_slots(rows, "shard", "doc_id", ["text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_topk(spark, sf_dir):
    """The 20 highest inner products of every vector whose id is divisible by 20 with all others."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise("embedding").alias("v"))
    return topk.top_k(e, F.col("vec_id") % 20 == 0, 20)


#: Weights of the sources by code point, repeating, and the most that a source or document is repeated.
MIX_WEIGHTS, MIX_MOST = (5.0, 2.0, 1.0), 3


def op6_mixing(spark, sf_dir):
    """Words that a mix of the size of all documents takes of each, weights 5, 2, 1 over the sources."""
    rows = mixing.sized_rows(_table(spark, sf_dir, "documents"))
    plan = mixing.mix_plan(rows, MIX_WEIGHTS, most=MIX_MOST)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op7_repeats(spark, sf_dir):
    """Words of all documents without those of 20-word windows that start earlier."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_langid(spark, sf_dir):
    """Language of all documents, learned from the two thirds whose crc32 mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold(3) != 1)
    return langid.identify(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from labelled ones whose crc32 mod 5 is not 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash(spark, sf_dir):
    """SimHash of 3-word shingles of all documents, linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_goodness(spark, sf_dir):
    """Quality of all documents, learned from labelled ones whose crc32 mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = goodness.fit(docs, _table(spark, sf_dir, "labels"), fold(3) != 1)
    scored = goodness.score(docs, weights)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark, sf_dir):
    """All vectors projected on the first 4 whitened components of their distinct values."""
    return whitening.whiten(whitening.whole_rows(_table(spark, sf_dir, "embeddings")), 4)


def op13_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 100 among all vectors, one label in seven moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    e = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), negatives.quantise("embedding").alias("v"))
    return negatives.mine(e, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_classlm, op4_sharding, op5_topk, op6_mixing, op7_repeats, op8_langid, op9_toxicity, op10_simhash, op11_goodness,
                                   op12_whitening, op13_negatives)}

#: Words without those of windows that start earlier. A word goes if one of the 20 windows that cover it goes.
REPEATS_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS place,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT rid, place, s, array_to_string(list_slice(words, s, s + 19), ' ') AS phrase
  FROM (SELECT rid, place, words, unnest(range(1, len(words) - 18)) AS s FROM docs)
), judged AS (
  SELECT rid, s, min(place) OVER (PARTITION BY phrase) < place OR min(s) OVER (PARTITION BY phrase, rid) < s AS goes
  FROM windows
), each_word AS (
  SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS s FROM docs
), covered AS (
  SELECT w.rid, w.s, w.word,
         bool_or(coalesce(j.goes, false)) OVER (PARTITION BY w.rid ORDER BY w.s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM each_word w LEFT JOIN judged j ON j.rid = w.rid AND j.s = w.s
), kept AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone) AS text
  FROM covered GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.rid = d.rid
"""

#: Ranked inner products of whole numbers; as doubles they are exact below 2**53.
TOPK_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), filled AS (
  SELECT rid, vec_id, list_resize(v, (SELECT max(len(v)) FROM whole), 0) AS v FROM whole
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.rid ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id NULLS LAST, c.rid) AS rank
  FROM filled q JOIN filled c ON q.rid <> c.rid
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Hard negatives from ranked inner products of whole numbers.
NEGATIVES_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), filled AS (
  SELECT rid, vec_id, label, list_resize(v, (SELECT max(len(v)) FROM whole), 0) AS v FROM whole
), pairs AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid AS crid, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM filled a JOIN filled c ON a.rid <> c.rid
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT arid, anchor_id, crid AS prid, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, crid) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.arid, p.prid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.crid) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.arid = p.arid AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {"op5_topk": TOPK_SQL, "op7_repeats": REPEATS_SQL, "op13_negatives": NEGATIVES_SQL}
