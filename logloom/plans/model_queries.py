"""Registered queries: feature vectors, isolation forest, importance, outlier factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import complexity
from logloom.operators import importance as I
from logloom.operators.correlate import match_requests
from logloom.operators.forest import isolation_forest
from logloom.operators.neighbours import flag_outliers, local_outlier_factor
from logloom.operators.transactions import transaction_features
from logloom.plans.match_queries import _SIDES, requests, responses
from logloom.plans.tables import rounded, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    df = match_requests(requests(spark, sf), responses(spark, sf))
    return df.withColumn("status_code", F.when(F.col("response_id") % 2 == 0, "Success"))


@query(
    f"""WITH {_SIDES}, tx AS (SELECT *, (epoch_us(response_timestamp) - epoch_us(request_timestamp)) / 1000000.0 AS d
    FROM req FULL OUTER JOIN resp ON request_id = in_response_to),
    f AS (SELECT *, lag(request_timestamp) OVER (ORDER BY request_timestamp NULLS LAST, request_id NULLS FIRST, response_id NULLS FIRST) AS prev,
      count(request_timestamp) OVER (PARTITION BY date_trunc('hour', request_timestamp)) AS per_hour,
      avg(d) OVER () AS m, stddev_samp(d) OVER () AS s FROM tx)
    SELECT request_id, response_id, in_response_to, hour(request_timestamp)::DOUBLE AS "hour", (isodow(request_timestamp) - 1)::DOUBLE AS day_of_week,
    CASE WHEN request_id IS NOT NULL AND response_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_complete,
    coalesce((response_id % 2 = 0)::INT, 0)::DOUBLE AS is_success, round(coalesce(d, 0), 3) AS transaction_duration_filled,
    coalesce(length(request_id::VARCHAR), 0)::DOUBLE AS request_id_length,
    coalesce((epoch_us(request_timestamp) - epoch_us(prev)) / 1000000.0, 0.0)::DOUBLE AS time_since_last,
    coalesce(per_hour, 0)::DOUBLE AS hourly_transaction_count, round(coalesce((d - m) / s, 0), 5) AS duration_z_score,
    (coalesce(sp_provider, '') = '1-URGENT')::INT::DOUBLE AS urgent, (sp_provider IS NULL)::INT::DOUBLE AS sp_nan
    FROM f""".replace('hour(request_timestamp)::DOUBLE AS "hour"', 'coalesce(hour(request_timestamp), 0)::DOUBLE AS "hour"').replace(
        '(isodow(request_timestamp) - 1)::DOUBLE AS day_of_week', 'coalesce(isodow(request_timestamp) - 1, 0)::DOUBLE AS day_of_week'
    )
)
def transaction_vectors(spark: SparkSession, sf: str) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None]
    df, _ = transaction_features(transactions(spark, sf), {"sp_provider": "sp_"}, {"sp_provider": levels})
    return df.select(
        "request_id", "response_id", "in_response_to", "hour", "day_of_week", "is_complete", "is_success",
        F.round("transaction_duration_filled", 3).alias("transaction_duration_filled"), "request_id_length",
        "time_since_last", "hourly_transaction_count", F.round("duration_z_score", 5).alias("duration_z_score"),
        F.col("`sp_1-URGENT`").alias("urgent"), "sp_nan",
    )


_LABELLED = """lab AS (SELECT l.doc_id, quality = 0 AS flag, n_chars, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS punctuation_count,
  len(regexp_extract_all(text, '\\p{Nd}+')) AS number_count FROM labels l JOIN documents d USING (doc_id))"""
_FEATURES = ["n_chars", "punctuation_count", "number_count"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    c = complexity(F.col("text"))
    docs = table(spark, sf, "documents").select(
        "doc_id", "n_chars", *[c[n].alias(n) for n in ("punctuation_count", "number_count")]
    )
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("flag"))
    return labels.join(docs, "doc_id")


def _importance_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, stddev_pop({f}) AS sd, avg({f}) FILTER (WHERE flag) AS ma, avg({f}) FILTER (WHERE NOT flag) AS mn,
      stddev_samp({f}) FILTER (WHERE flag) AS sa, stddev_samp({f}) FILTER (WHERE NOT flag) AS sn,
      count(*) FILTER (WHERE flag) AS na, count(*) FILTER (WHERE NOT flag) AS nn FROM lab"""


@query(
    f"""WITH {_LABELLED}, s AS ({" UNION ALL ".join(_importance_sql(f) for f in _FEATURES)}),
    t AS (SELECT feature, abs(ma - mn) / sd AS mean_diff, (sa / sd) / (sn / sd + 1e-8) AS std_ratio,
      sqrt(((na - 1) * pow(sa / sd, 2) + (nn - 1) * pow(sn / sd, 2)) / (na + nn - 2)) AS pooled FROM s)
    SELECT feature, round(mean_diff * (1 + abs(std_ratio - 1)) * mean_diff / (pooled + 1e-8), 6) AS importance,
    round(mean_diff, 6) AS mean_diff, round(std_ratio, 6) AS std_ratio, round(mean_diff / (pooled + 1e-8), 6) AS cohens_d FROM t"""
)
def effect_size_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.statistical_importance(labelled(spark, sf), "flag", _FEATURES))


def _extreme_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, avg(flag::INT) FILTER (WHERE {f} < (SELECT quantile_cont({f}, 0.1) FROM lab)
      OR {f} > (SELECT quantile_cont({f}, 0.9) FROM lab)) AS r, avg(flag::INT) AS o FROM lab"""


@query(
    f"""WITH {_LABELLED} SELECT feature, round(r - o, 6) AS contribution, round(r, 6) AS extreme_anomaly_rate,
    round(o, 6) AS overall_anomaly_rate FROM ({" UNION ALL ".join(_extreme_sql(f) for f in _FEATURES)})"""
)
def extreme_value_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.extreme_importance(labelled(spark, sf), "flag", _FEATURES))


def _permuted_sql(f: str, seed: int) -> str:
    """Mean change of the score when ``f`` comes from the next row in the order of a hash."""
    other = {x: x for x in ("n_chars", "punctuation_count")} | {f: "p"}
    return f"""SELECT '{f}' AS feature, abs(avg(abs({other["n_chars"]} / ({other["punctuation_count"]} + 1))) - (SELECT m FROM base)) AS change
      FROM (SELECT *, coalesce(lead({f}) OVER w, first_value({f}) OVER w) AS p FROM lab
      WINDOW w AS (ORDER BY md5('{seed}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    f"""WITH {_LABELLED}, base AS (SELECT avg(abs(n_chars / (punctuation_count + 1))) AS m FROM lab),
    c AS ({" UNION ALL ".join(_permuted_sql(f, 11 + r) for f in ("n_chars", "punctuation_count") for r in range(2))})
    SELECT feature, round(avg(change), 6) AS importance_mean, round(stddev_pop(change), 6) AS importance_std FROM c GROUP BY 1"""
)
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Change of a simple length score when one feature is shuffled."""

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.abs(F.col("n_chars") / (F.col("punctuation_count") + 1)))

    return rounded(I.permutation_importance(labelled(spark, sf), "doc_id", ["n_chars", "punctuation_count"], score, 2))


@query(None)
def isolation_forest_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    df = isolation_forest(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 0.1)
    return df.select("vec_id", "iso_score", "anomaly_score", "is_anomaly", "anomaly_label")


@query(
    """WITH d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS place FROM d) WHERE place <= 10),
    kd AS (SELECT id, max(dist) AS k_dist FROM near GROUP BY 1),
    lrd AS (SELECT near.id, 1.0 / (avg(greatest(dist, k_dist)) + 1e-10) AS lrd FROM near JOIN kd ON kd.id = near.other GROUP BY 1),
    lof AS (SELECT near.id, avg(o.lrd) / any_value(i.lrd) AS lof FROM near JOIN lrd o ON o.id = near.other JOIN lrd i ON i.id = near.id GROUP BY 1)
    SELECT id, round(lof, 5) AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM lof) + 1e-12 AS is_anomaly FROM lof"""
)
def outlier_factor_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    scored = local_outlier_factor(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)
    return rounded(flag_outliers(scored, 0.1), 5)
