"""The numbered queries over the test tables, with oracle SQL where SQL can say the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from atalaya.llm import exact_dedup as dedup, langid, mixing, negatives, neighbours, packing, phrases, quality, secrets, sharding, simhash, suffixes, toxicity
from atalaya.llm.common import fold, table

QUERIES = {}
ORACLES = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_files() -> tuple[str, str, dict[str, int]]:
    """Ranks of the 50k byte-level BPE (the vocabulary of byte_bpe_50k.json), its pattern and the json's added tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())
    return packed.withColumnRenamed("id", "doc_id")


@query
def op5_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op5_block_matrix_ann"] = """
    WITH v AS (
      SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vec, c.vec) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 20 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM p QUALIFY rank <= 20
"""


def held_out(parts: int, held: int):
    return F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "n_markov",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held_out(5, 0), "score", "predicted")


@query
def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held_out(3, 1), "score", "predicted")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tagged = langid.tag(docs.select("doc_id", "text"), langid.train(docs))
    return tagged.select("doc_id", held_out(3, 1), "lang_pred", "score")


@query
def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (dedup.exact_dedup(docs, carry=["doc_id"])
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


ORACLES["op9_exact_dedup"] = f"""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

MIX_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2,
               ("*", "es"): 2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 5), 2, 7


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (mixing.mix_sources(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED, carry=["doc_id"])
            .select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens"))


def _weights_sql(depth: int, columns: list[str]) -> str:
    cases = []
    for path, weight in MIX_WEIGHTS.items():
        if len(path) == depth:
            same = [f"{c} = '{name}'" for c, name in zip(columns, path) if name != "*"]
            cases.append(f"WHEN {' AND '.join(same)} THEN {weight}")
    return f"CASE {' '.join(cases)} ELSE 1 END" if cases else "1"


def _level_sql(depth: int) -> str:
    columns = ["mix_domain", "mix_lang", "mix_source"][:depth]
    path, parents = ", ".join(columns), ", ".join(columns[:-1])
    siblings = f"PARTITION BY {parents}" if parents else ""
    join = f"JOIN a{depth - 1} USING ({parents})" if parents else "CROSS JOIN a0"
    return f"""
    n{depth} AS (
      SELECT {path}, q.cap, q.tokens, alloc AS given, ({_weights_sql(depth, columns)})::HUGEINT AS weight
      FROM (SELECT {path}, sum(tokens) * {MIX_EPOCHS} AS cap, sum(tokens) AS tokens FROM leaf GROUP BY {path}) q {join}),
    s{depth} AS (
      SELECT *, weight * (given - sum(cap) OVER o) >= cap * (sum(weight) OVER p - sum(weight) OVER o) AS saturated
      FROM n{depth}
      WINDOW o AS ({siblings} ORDER BY cap::DOUBLE / weight::DOUBLE, {columns[-1]} ROWS UNBOUNDED PRECEDING),
             p AS ({siblings})),
    a{depth} AS (
      SELECT {path}, tokens, CASE WHEN saturated THEN cap ELSE
        weight * (given - coalesce(sum(cap) FILTER (saturated) OVER p, 0)) // sum(weight) FILTER (NOT saturated) OVER p
        END AS alloc
      FROM s{depth} WINDOW p AS ({siblings}))"""


ORACLES["op10_source_mixing"] = f"""
    WITH doc AS (
      SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(lang, '{mixing.NONE}') AS mix_lang,
             coalesce(source, '{mixing.NONE}') AS mix_source,
             CASE WHEN left(md5(coalesce(source, '{mixing.NONE}')), 1) < '4' THEN 'd0'
                  WHEN left(md5(coalesce(source, '{mixing.NONE}')), 1) < '8' THEN 'd1'
                  WHEN left(md5(coalesce(source, '{mixing.NONE}')), 1) < 'c' THEN 'd2' ELSE 'd3' END AS mix_domain,
             len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS mix_tokens
      FROM documents),
    leaf AS (SELECT mix_domain, mix_lang, mix_source, sum(mix_tokens)::HUGEINT AS tokens FROM doc GROUP BY ALL),
    a0 AS (SELECT sum(tokens) * {MIX_SHARE[0]} // {MIX_SHARE[1]} AS alloc FROM leaf),
    {_level_sql(1)}, {_level_sql(2)}, {_level_sql(3)},
    b AS (SELECT mix_domain, mix_lang, mix_source, (alloc // tokens)::BIGINT AS epochs, alloc % tokens AS part
          FROM a3 WHERE tokens > 0),
    u AS (SELECT *, md5(concat_ws('|', '{MIX_SEED}', epochs::VARCHAR, key)) AS place
          FROM doc JOIN b USING (mix_domain, mix_lang, mix_source)),
    t AS (SELECT *, epochs + CASE WHEN part > 0 AND sum(mix_tokens) OVER (
            PARTITION BY mix_domain, mix_lang, mix_source ORDER BY place RANGE UNBOUNDED PRECEDING) <= part
            THEN 1 ELSE 0 END AS taken FROM u)
    SELECT doc_id, mix_domain, mix_lang, mix_source, unnest(range(taken)) AS mix_epoch, mix_tokens::BIGINT AS mix_tokens
    FROM t
"""


@query
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    f AS (
      SELECT lang, m, phrase, count(*) AS a
      FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM words CROSS JOIN range(1, 5) AS s(m) WHERE len(w) >= m)
      GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (
      SELECT c.lang, c.m, c.phrase, c.a, k, string_split(c.phrase, ' ') AS w,
             array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
      FROM f c CROSS JOIN range(1, 4) AS s(k) WHERE k < c.m),
    scored AS (
      SELECT cuts.lang, cuts.m, cuts.phrase, cuts.a, h.a AS l, t.a AS r,
             (2000000::HUGEINT * cuts.a // (h.a + t.a))::BIGINT AS score
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
      QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, array_to_string(w[i:i + m2 - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 2)
           CROSS JOIN range(2, 4) AS s(m2) CROSS JOIN range(1, 4) AS u(i)
      WHERE m2 < m AND i + m2 - 1 <= m GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM scored LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
    WHERE longer IS NULL OR 100 * longer < 80 * a
    QUALIFY rank <= 2000
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", label.alias("label"), whole.alias("vector"))
    return negatives.hard_negatives(rows)


ORACLES["op13_hard_negatives"] = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.vec, c.vec)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5
"""
