"""The registered queries of the operators in this subpackage, and their SQL counterparts."""

from __future__ import annotations

import string
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    bpe,
    hard_negatives,
    merkle,
    neighbour_graph,
    ngram_join,
    packing,
    pii,
    rule_quality,
    secret_scan,
    sharding,
    spherical_filters,
    token_counts,
    training_order,
)
from logloom.session import shared_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded; digests of both."""
    encoded = bpe.encode(_table(spark, sf, "documents"), WORD_BPE)
    return bpe.decode(encoded, WORD_BPE).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf, "documents"), BYTE_BPE)
    return counts.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit")
    )


def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    classes = ngram_join.ngram_classes(_table(spark, sf, "documents"), words=3, percent=90)
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_OP3_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION
  SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c.component_id
FROM sets JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) c ON c.d = sets.doc_id
"""


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(packing.pieces(_table(spark, sf, "documents"), BYTE_BPE))
    return packed.withColumnRenamed("id", "doc_id")


def _joined(spans: str | Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf, "documents"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("id").alias("doc_id"),
        *[_count("secrets", kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("secrets").alias("spans"),
    )


def op6_training_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence with its slot, and a checksum of what its record in the shard files holds."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    cut = training_order.sequences(_table(spark, sf, "documents"), BYTE_BPE)
    index = training_order.write_shards(cut, path)
    if index.isEmpty():
        return index.select(F.col("id").alias("doc_id"), "start", "n_docs", "n_tokens", "slot", "shard").withColumn(
            "record_crc32", F.lit(None).cast("long")
        )
    records = training_order.read_records(spark, path)
    read = records.select("slot", F.crc32("record").alias("record_crc32"))
    return index.join(read, "slot", "left").select(
        F.col("id").alias("doc_id"), "start", "n_docs", "n_tokens", "slot", "shard", "record_crc32"
    )


def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_graph.nearest(_table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op8_stratified_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.interleaved(_table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = rule_quality.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *rule_quality.COUNTS, "base_failed", "kept", "score")


def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != pii.CONTEXT)
    return found.select(
        F.col("id").alias("doc_id"),
        *[_count("spans", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        _count("spans", pii.CONTEXT).alias("n_context"),
    )


def op11_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = spherical_filters.near_duplicates(_table(spark, sf, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


_OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS z FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.z) = len(b.z) AND list_cosine_similarity(a.z, b.z) >= 0.98),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a),
found AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN found ON d = vec_id
"""


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector's hard negatives; every seventh has a wrong label."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf, "embeddings").withColumn("label", wrong)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


_OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE) FOR x IN embedding] AS z FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.z, b.z)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
wins AS (SELECT a, b AS p, s AS ps FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, b AS negative_id, ps AS positive_score, s AS negative_score,
  row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b)::INTEGER AS rank
FROM wins JOIN met USING (a) WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps QUALIFY rank <= 10
"""


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof; a fifth of them is read with its text in lower case."""
    shown = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    proved = merkle.manifest(
        _table(spark, sf, "documents"),
        shown=[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [shown],
        changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
    )
    return proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda crc, b: list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""
_OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC_SQL} % 5 = 0 THEN
  {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS changed FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
sub AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM placed UNION ALL
  SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM sub WHERE n > 1
  GROUP BY tree, level, i // 16, n),
roots AS (SELECT tree AS i, h AS subroot, max(level) OVER () AS height FROM sub WHERE n = 1),
top AS (SELECT 0 AS level, i, count(*) OVER () AS n, subroot AS h FROM roots UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1
  GROUP BY level, i // 16, n),
near AS (SELECT doc_id, level, coalesce(string_agg(h, '' ORDER BY s.i) FILTER (WHERE s.i < (p.i >> (4 * level))), '') AS before,
  coalesce(string_agg(h, '' ORDER BY s.i) FILTER (WHERE s.i > (p.i >> (4 * level))), '') AS after
  FROM placed p JOIN sub s ON s.tree = p.tree AND s.n > 1 AND s.i // 16 = (p.i >> (4 * level + 4)) GROUP BY doc_id, level
  UNION ALL SELECT doc_id, 1000 + level, coalesce(string_agg(h, '' ORDER BY s.i) FILTER (WHERE s.i < (p.tree >> (4 * level))), ''),
  coalesce(string_agg(h, '' ORDER BY s.i) FILTER (WHERE s.i > (p.tree >> (4 * level))), '')
  FROM placed p JOIN top s ON s.n > 1 AND s.i // 16 = (p.tree >> (4 * level + 4)) GROUP BY doc_id, level),
paths AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof,
  list(before || ':' || after ORDER BY level) AS path FROM near GROUP BY doc_id)
SELECT doc_id, leaf, subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM (SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), coalesce(path, [])),
  lambda a, x: sha256(split_part(x, ':', 1) || a || split_part(x, ':', 2))) AS folded_root
  FROM placed LEFT JOIN paths USING (doc_id)) p
JOIN roots r ON r.i = p.tree JOIN (SELECT h FROM top WHERE n = 1) t ON true
"""


def _kind_sql(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind: the pieces between the matches give the places."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
  list_sum([length(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0) AS s,
  length(found[i]) AS n
  FROM (SELECT doc_id, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM
    (SELECT doc_id, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS pieces FROM documents))
  WHERE {keep}"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_OP5_SQL = f"""
WITH spans AS (
{_kind_sql(0, "assign", _ASSIGN, "length(regexp_extract(found[i], '[A-Za-z0-9+/_.=-]+$')) >= 6 OR regexp_matches(found[i], '[:=][ ]*[A-Za-z0-9+/_.=-]{6,}$')")}
UNION ALL {_kind_sql(1, "access", "AKIA[A-Z0-9]+", "length(found[i]) >= 20")}
UNION ALL {_kind_sql(2, "hex", "[0-9a-f]+", "length(found[i]) >= 24")}
UNION ALL {_kind_sql(3, "github", "gh[pousr]_[A-Za-z0-9]+", "length(found[i]) >= 40")}
UNION ALL {_kind_sql(4, "slack", "xox[abprs]-[A-Za-z0-9-]+", "length(found[i]) >= 20")}
UNION ALL {_kind_sql(5, "google", "AIza[A-Za-z0-9_-]+", "length(found[i]) >= 39")}),
named AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM spans),
per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
  count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_training_order": op6_training_order,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_stratified_shards": op8_stratified_shards,
    "op9_quality_rules": op9_quality_rules,
    "op10_personal_data": op10_personal_data,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op3_ngram_jaccard": _OP3_SQL,
    "op5_secret_scan": _OP5_SQL,
    "op11_embedding_near_dedup": _OP11_SQL,
    "op12_hard_negatives": _OP12_SQL,
    "op13_merkle_manifest": _OP13_SQL,
}
