"""SQL with the same results as the registered queries, for DuckDB on the driver's tables."""

from __future__ import annotations

# One text per shared step; a query names the steps it needs.
STEPS = {
    "catalog": """
        catalog AS (
            SELECT p_partkey AS id, p_type AS kind, p_name AS title, p_size % 2 AS flag,
                   CASE WHEN p_size % 10 <> 0 THEN p_size END AS runtime,
                   replace(p_name, ' ', ',') AS genres,
                   round(avg(l_quantity) / 5, 4) AS rating, count(*) AS votes,
                   coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)
                       FILTER (WHERE l_linenumber = 1)), ','), '\\N') AS directors,
                   coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)
                       FILTER (WHERE l_linenumber = 2)), ','), '\\N') AS writers
            FROM part JOIN lineitem ON p_partkey = l_partkey
            GROUP BY p_partkey, p_type, p_name, p_size)""",
    "titles": """
        titles AS (
            SELECT id, kind, title, flag, runtime, rating, votes,
                   string_split(genres, ',') AS genres,
                   string_split(directors, ',') AS directors,
                   string_split(writers, ',') AS writers,
                   row_number() OVER (ORDER BY votes, id) AS nth
            FROM catalog)""",
    "holdout": """
        holdout AS (SELECT * FROM titles WHERE nth % 4 = 0)""",
    "asked": """
        holdout AS (SELECT * FROM titles WHERE kind LIKE 'ECONOMY%')""",
    "genre_words": """
        genre_words AS (
            SELECT token, row_number() OVER (ORDER BY token) - 1 AS pos
            FROM (SELECT DISTINCT unnest(genres) AS token FROM titles) AS g)""",
    "director_counts": """
        director_counts AS (
            SELECT token, count(*) AS n FROM (SELECT unnest(directors) AS token FROM titles) AS d GROUP BY token)""",
    "director_words": """
        director_words AS (
            SELECT token, pos FROM (
                SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS pos
                FROM director_counts WHERE token <> '\\N') AS r
            WHERE pos < 500)""",
    "cells": """
        widths AS (
            SELECT (SELECT count(*) FROM genre_words) AS g, (SELECT count(*) FROM director_words) AS d,
                   (SELECT avg(runtime) FROM titles) AS mean),
        cells AS (
            SELECT id, 0 AS pos, flag::DOUBLE AS value FROM titles
            UNION ALL
            SELECT id, 1 + pos, 1.0 FROM (SELECT id, unnest(genres) AS token FROM titles) AS x JOIN genre_words USING (token)
            UNION ALL
            SELECT id, 1 + g, coalesce(runtime - mean, 0.0) FROM titles, widths
            UNION ALL
            SELECT id, 2 + g + k, 1.0 FROM titles, widths,
                   (VALUES ('ECONOMY', 0), ('SMALL', 1), ('STANDARD', 2)) AS kinds(kind_name, k)
            WHERE kind = kind_name
            UNION ALL
            SELECT id, 5 + g + pos, 1.0 FROM (SELECT id, unnest(directors) AS token FROM titles) AS y
                   JOIN director_words USING (token), widths)""",
    "feature_split": """
        norms AS (SELECT id, sqrt(sum(value * value)) AS norm FROM cells GROUP BY id),
        train AS (SELECT id, rating FROM titles WHERE nth % 4 <> 0),
        batch AS (SELECT id AS qid FROM titles WHERE nth % 4 = 0),
        pairs AS (
            SELECT q.id AS qid, c.id AS id, sum(q.value * c.value) AS dot
            FROM cells AS q JOIN cells AS c USING (pos)
            WHERE q.id IN (SELECT qid FROM batch) AND c.id IN (SELECT id FROM train)
            GROUP BY q.id, c.id),
        scored AS (
            SELECT qid, p.id AS id, rating, round(dot / (n.norm * m.norm), 9) AS score
            FROM pairs AS p JOIN norms AS n ON n.id = qid JOIN norms AS m ON m.id = p.id JOIN train ON train.id = p.id)""",
    "feature_signs": """
        planes AS (
            SELECT k, pos, CASE WHEN substr(md5(k::VARCHAR || ':' || pos::VARCHAR), 1, 1) >= '8' THEN 1.0 ELSE -1.0 END AS sign
            FROM range({planes}) AS t(k), (SELECT DISTINCT pos FROM cells) AS p),
        signs AS (
            SELECT id, k, CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1
                               WHEN substr(md5(id::VARCHAR || ':' || k::VARCHAR), 1, 1) >= '8' THEN 1 ELSE -1 END AS s
            FROM (SELECT id, k, sum(value * sign) AS x FROM cells JOIN planes USING (pos) GROUP BY id, k) AS d)""",
    "vectors": """
        vectors AS (
            SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::DOUBLE AS rating,
                   row_number() OVER (ORDER BY label, vec_id) AS nth
            FROM embeddings)""",
    "hard_vectors": """
        vectors AS (
            SELECT vec_id AS id,
                   list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE x END)::DOUBLE[] AS v,
                   label::DOUBLE AS rating, row_number() OVER (ORDER BY label, vec_id) AS nth
            FROM embeddings)""",
    "hard_titles": """
        titles AS (
            SELECT id, kind, CASE WHEN id % 11 <> 0 THEN title END AS title, flag, runtime, rating, votes,
                   CASE WHEN id % 13 = 0 THEN NULL
                        WHEN id % 7 = 0 THEN list_concat(string_split(genres, ','), string_split(genres, ',')[1:1])
                        ELSE string_split(genres, ',') END AS genres,
                   string_split(directors, ',') AS directors,
                   string_split(writers, ',') AS writers,
                   row_number() OVER (ORDER BY votes, id) AS nth
            FROM catalog)""",
    "split": """
        train AS (SELECT * FROM vectors WHERE nth % 4 <> 0),
        batch AS (SELECT id AS qid, v, rating FROM vectors WHERE nth % 4 = 0)""",
    "exact": """
        ranked AS (
            SELECT qid, id, score, rating, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
            FROM (SELECT qid, id, train.rating AS rating,
                         round(list_dot_product(batch.v, train.v)
                               / (sqrt(list_dot_product(batch.v, batch.v)) * sqrt(list_dot_product(train.v, train.v))), 9)
                         AS score
                  FROM batch, train) AS p)""",
    "planes": """
        planes AS (
            SELECT k, list_transform(range(64), lambda d:
                       CASE WHEN substr(md5(k::VARCHAR || ':' || d::VARCHAR), 1, 1) >= '8' THEN 1.0 ELSE -1.0 END::DOUBLE) AS p
            FROM range({planes}) AS t(k))""",
    "signs": """
        signs AS (
            SELECT id, k, CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1
                               WHEN substr(md5(id::VARCHAR || ':' || k::VARCHAR), 1, 1) >= '8' THEN 1 ELSE -1 END AS s
            FROM (SELECT id, k, list_dot_product(v, p) AS x FROM vectors, planes) AS d)""",
    "banded": """
        banded AS (
            SELECT id, k // {per} AS band,
                   ((1 << {per}) + sum(CASE WHEN s > 0 THEN 1 << ({per} - 1 - k % {per})::INTEGER ELSE 0 END))::BIGINT AS band_key,
                   string_agg(s::VARCHAR, ',' ORDER BY k) AS band_text,
                   sum(s)::INTEGER AS band_sum
            FROM signs GROUP BY id, k // {per})""",
    "index": """
        train_bands AS (SELECT id, band, band_key FROM banded WHERE id IN (SELECT id FROM train)),
        batch_bands AS (SELECT id AS qid, band, band_key FROM banded WHERE id IN (SELECT qid FROM batch)),
        sizes AS (SELECT band, band_key, count(*) AS size FROM train_bands GROUP BY band, band_key),
        hits AS (
            SELECT qid, band, band_key, size,
                   size <= floor((SELECT count(*) FROM train) * {share}) AS small
            FROM batch_bands JOIN sizes USING (band, band_key)),
        flagged AS (
            SELECT *, bool_or(small) OVER (PARTITION BY qid) AS any_small,
                   row_number() OVER (PARTITION BY qid ORDER BY size, band) AS place
            FROM hits),
        candidates AS (
            SELECT DISTINCT qid, id AS cand_id
            FROM flagged JOIN train_bands USING (band, band_key)
            WHERE small OR (NOT any_small AND place = 1))""",
    "lsh_ranked": """
        lsh_ranked AS (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank,
                   row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS id_rank
            FROM (SELECT qid, id, train.rating AS rating,
                         round(list_dot_product(batch.v, train.v)
                               / (sqrt(list_dot_product(batch.v, batch.v)) * sqrt(list_dot_product(train.v, train.v))), 9)
                         AS score
                  FROM candidates JOIN batch USING (qid) JOIN train ON train.id = cand_id) AS p)""",
}


def sql(steps: str, body: str, **values) -> str:
    names = steps.split()
    text = "WITH " + ",".join(STEPS[name] for name in names) + "\n" + body if names else body
    for name, value in {"planes": 25, "per": 5, **values}.items():
        text = text.replace("{" + name + "}", str(value))
    return text


def overlap(a: str, b: str, mode: str) -> str:
    """Overlap of two lists of distinct items, as SQL."""
    if mode == "repeats":
        common = (
            f"list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)),"
            f" len(list_filter({b}, lambda z: z = x)))))"
        )
        value = f"{common}::DOUBLE / greatest(len({a}), len({b}))"
    elif mode == "exact":
        value = f"CASE WHEN list_sort({a}) = list_sort({b}) THEN 1.0 ELSE 0.0 END"
    else:
        value = f"len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b}))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR list_contains({a}, '\\N') OR list_contains({b}, '\\N') THEN 0.0::DOUBLE ELSE ({value})::DOUBLE END"
    )


def attribute_parts(a: str, b: str, mode: str) -> dict[str, str]:
    return {
        "flag_sim": f"CASE WHEN {a}.flag = {b}.flag THEN 1.0 ELSE 0.0 END::DOUBLE",
        "runtime_sim": (
            f"1.0::DOUBLE - abs(coalesce({a}.runtime, 0) - coalesce({b}.runtime, 0))"
            f" / (coalesce({a}.runtime, 0) + coalesce({b}.runtime, 0) + 0.01::DOUBLE)"
        ),
        "genre_sim": overlap(f"{a}.genres", f"{b}.genres", mode),
        "writer_sim": overlap(f"{a}.writers", f"{b}.writers", mode),
        "director_sim": overlap(f"{a}.directors", f"{b}.directors", mode),
    }


SCORE = (
    "(flag_sim * 1.0::DOUBLE + runtime_sim * 1.0::DOUBLE + genre_sim * 1.2::DOUBLE"
    " + writer_sim * 2.0::DOUBLE + director_sim * 2.0::DOUBLE) / 7.2::DOUBLE"
)


def attribute_pairs(mode: str) -> str:
    parts = ", ".join(f"{value} AS {name}" for name, value in attribute_parts("a", "b", mode).items())
    return sql(
        "catalog titles",
        f"""SELECT id, other, flag_sim, round(runtime_sim, 6) AS runtime_sim, round(genre_sim, 6) AS genre_sim,
                   round(writer_sim, 6) AS writer_sim, round(director_sim, 6) AS director_sim, round({SCORE}, 6) AS score
            FROM (SELECT a.id AS id, b.id AS other, {parts} FROM titles AS a JOIN titles AS b ON b.nth = a.nth + 1) AS p""",
    )


def attribute_ranked(
    mode: str, where: str, body: str, titles: str = "titles", holdout: str = "holdout", tie: str = "id"
) -> str:
    parts = ", ".join(f"{value} AS {name}" for name, value in attribute_parts("c", "q", mode).items())
    ranked = f""",
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {tie}) AS rank
            FROM (SELECT qid, id, rating, votes, round({SCORE}, 9) AS score
                  FROM (SELECT q.id AS qid, c.id AS id, c.rating AS rating, c.votes AS votes, {parts}
                        FROM holdout AS q JOIN titles AS c ON c.title <> q.title WHERE {where}) AS p) AS s)
        """
    return sql(f"catalog {titles} {holdout}", "").rstrip() + ranked + body


def histogram(source: str) -> str:
    return f"""
        , bounds AS (SELECT min(rating) AS lo, max(rating) AS hi, (max(rating) - min(rating)) / 10 AS w FROM {source}),
        edges AS (SELECT i AS bin, lo + i * w AS low, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * w END AS high
                  FROM bounds, range(10) AS t(i)),
        placed AS (SELECT rating, (SELECT max(bin) FROM edges WHERE low <= rating) AS bin FROM {source})
        SELECT edges.bin::INTEGER AS bin, round(low, 6) AS low, round(high, 6) AS high, count(rating) AS n
        FROM edges LEFT JOIN placed ON placed.bin = edges.bin GROUP BY ALL"""


def summary(column: str) -> str:
    value = f"{column}::DOUBLE"
    return f"""SELECT '{column}' AS "column", count({column}) AS n,
        -- values have four places at most: whole numbers, so that neither order nor a last bit decides
        ((200 * sum(CAST(round({value} * 10000) AS HUGEINT)) + count({column})) // (2 * count({column}))) / 1e6 AS mean,
        round(max({value}), 6) AS max, round(min({value}), 6) AS min, round(stddev_samp({value}), 6) AS std,
        round(quantile_cont({value}, 0.25), 6) AS q1, round(quantile_cont({value}, 0.5), 6) AS q2,
        round(quantile_cont({value}, 0.75), 6) AS q3 FROM titles"""


TIMED = """timed AS (SELECT 'p' || p_partkey AS id, p_size / 5 AS predicted, round(p_retailprice / 200, 3) AS seconds FROM part)"""
FEATURES = "catalog titles genre_words director_counts director_words cells"
LSH = "vectors split planes signs banded index"
CATALOG_TEXT = "SELECT id, rating, votes, kind, title, flag, runtime, genres, directors, writers FROM catalog"

SQL: dict[str, str] = {
    "catalog_join": sql("catalog", CATALOG_TEXT),
    "list_split_join": sql(
        "catalog",
        "SELECT id, len(string_split(directors, ','))::BIGINT AS n_items, directors AS joined FROM catalog",
    ),
    "kind_filter": sql(
        "catalog",
        """SELECT kind, count(*) AS titles, count(*) FILTER (WHERE flag = 1) AS flagged FROM catalog
           WHERE kind IN ('ECONOMY', 'SMALL', 'STANDARD') GROUP BY kind""",
    ),
    "flagged_count": sql("catalog", "SELECT count(*) FILTER (WHERE flag = 1) AS flagged FROM catalog"),
    "semi_lookup": sql(
        "catalog",
        """SELECT id, title, rating, votes FROM catalog
           WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
    ),
    "attribute_similarity_exact": attribute_pairs("exact"),
    "attribute_similarity_ratio": attribute_pairs("ratio"),
    "attribute_top50": attribute_ranked(
        "ratio", "true", "SELECT qid, id, rank::INTEGER AS rank, score FROM ranked WHERE rank <= 50"
    ),
    "attribute_top50_exact": attribute_ranked(
        "exact",
        "c.kind IN ('ECONOMY', 'SMALL', 'STANDARD')",
        "SELECT qid, id, rank::INTEGER AS rank, score FROM ranked WHERE rank <= 50",
    ),
    "attribute_predict": attribute_ranked(
        "ratio",
        "true",
        """SELECT qid, predicted, substr(predicted::VARCHAR, 1, 3) AS shown
           FROM (SELECT qid, round(sum(rating * (votes * score)) / sum(votes * score), 6) AS predicted
                 FROM ranked WHERE rank <= 50 GROUP BY qid) AS m""",
    ),
    "runtime_centred": sql(
        "catalog titles",
        """SELECT id, runtime, round(runtime - mean, 6) AS avg_runtime, round(coalesce(runtime - mean, 0.0), 6) AS filled
           FROM titles, (SELECT avg(runtime) AS mean FROM titles) AS m""",
    ),
    "kind_onehot": sql(
        "catalog",
        """SELECT id, kind, (kind = 'ECONOMY')::INTEGER::DOUBLE AS is_economy, (kind = 'SMALL')::INTEGER::DOUBLE AS is_small,
                  (kind = 'STANDARD')::INTEGER::DOUBLE AS is_standard FROM catalog""",
    ),
    "tag_multihot": sql(
        "catalog titles genre_words",
        """SELECT id, pos::INTEGER AS pos, list_contains(genres, token)::INTEGER::DOUBLE AS value FROM titles, genre_words""",
    ),
    "maker_top_multihot": sql(
        "catalog titles director_counts director_words",
        """SELECT id, pos::INTEGER AS pos, 1.0::DOUBLE AS value
           FROM (SELECT id, unnest(directors) AS token FROM titles) AS x JOIN director_words USING (token)""",
    ),
    "maker_top_multihot_compat": sql(
        "catalog titles director_counts",
        """SELECT id, pos::INTEGER AS pos, 1.0::DOUBLE AS value
           FROM (SELECT id, unnest(directors) AS token FROM titles) AS x
           JOIN (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 2 AS pos FROM director_counts) AS r USING (token)
           WHERE pos >= 0 AND pos < 500""",
    ),
    "vocabulary": sql(
        "catalog titles genre_words director_counts director_words",
        """SELECT pos::INTEGER AS pos, name FROM (
               SELECT 0 AS pos, 'flag' AS name
               UNION ALL SELECT 1 + pos, 'is_' || token FROM genre_words
               UNION ALL SELECT 1 + (SELECT count(*) FROM genre_words) + i, name
                         FROM (VALUES (0, 'avg_runtime'), (1, 'is_ECONOMY'), (2, 'is_SMALL'), (3, 'is_STANDARD')) AS f(i, name)
               UNION ALL SELECT 5 + (SELECT count(*) FROM genre_words) + pos, token FROM director_words) AS v""",
    ),
    "feature_vector": sql(
        "catalog titles genre_words director_counts director_words cells",
        """SELECT id, (5 + g + d)::INTEGER AS length, pos::INTEGER AS pos, round(value, 6) AS value
           FROM cells, widths WHERE value <> 0""",
    ),
    "global_rank": sql("catalog titles", "SELECT id, votes, nth FROM titles"),
    "split_train": sql("catalog titles", "SELECT id, votes, rating FROM titles WHERE nth % 4 <> 0"),
    "split_test": sql("catalog titles holdout", "SELECT id, votes, rating FROM holdout"),
    "limit_rows": sql("catalog titles holdout", "SELECT id, votes FROM holdout ORDER BY id LIMIT 10"),
    "dot_pairs": sql(
        "vectors",
        """SELECT a.id AS id, b.id AS other, round(list_dot_product(a.v, b.v), 6) AS dot
           FROM vectors AS a JOIN vectors AS b ON b.nth = a.nth + 1""",
    ),
    "cosine_pairs": sql(
        "vectors",
        """SELECT a.id AS id, b.id AS other, round(sqrt(list_dot_product(a.v, a.v)), 6) AS magnitude,
                  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)
                  AS cosine
           FROM vectors AS a JOIN vectors AS b ON b.nth = a.nth + 1""",
    ),
    "cosine_top10": sql(
        "vectors split exact",
        "SELECT qid, id, rank::INTEGER AS rank, score FROM ranked WHERE rank <= 10",
    ),
    "cosine_predict": sql(
        "vectors split exact", "SELECT qid, round(avg(rating), 6) AS predicted FROM ranked WHERE rank <= 10 GROUP BY qid"
    ),
    "cosine_predict_features": sql(
        FEATURES + " feature_split",
        """SELECT qid, round(avg(rating), 6) AS predicted
           FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) AS r
           WHERE rank <= 10 GROUP BY qid""",
    ),
    "lsh_predict_features": sql(
        FEATURES + " feature_split feature_signs banded index",
        """SELECT batch.qid AS qid, predicted FROM batch LEFT JOIN
               (SELECT qid, round(avg(rating), 1) AS predicted
                FROM (SELECT scored.qid AS qid, rating,
                             row_number() OVER (PARTITION BY scored.qid ORDER BY score DESC, id) AS rank
                      FROM scored JOIN candidates ON candidates.qid = scored.qid AND cand_id = id) AS r
                WHERE rank <= 10 GROUP BY qid) AS m
           ON m.qid = batch.qid""",
        share=0.5,
    ),
    "lsh_signature": sql(
        "vectors planes signs", "SELECT id, string_agg(s::VARCHAR, ',' ORDER BY k) AS signature FROM signs GROUP BY id"
    ),
    "lsh_buckets": sql(
        "vectors planes signs banded",
        """SELECT band::INTEGER AS band, band_key, count(*) AS size, min(id) AS first_id, max(id) AS last_id
           FROM banded GROUP BY band, band_key""",
    ),
    "band_key_mod": sql(
        "vectors planes signs banded", "SELECT id, band::INTEGER AS band, band_sum % 13 AS band_key FROM banded"
    ),
    "band_key_sha256": sql(
        "vectors planes signs banded", "SELECT id, band::INTEGER AS band, sha256(band_text) AS band_key FROM banded"
    ),
    "band_key_text": sql(
        "vectors planes signs banded", "SELECT id, band::INTEGER AS band, band_text AS band_key FROM banded"
    ),
    "lsh_candidates": sql(LSH, "SELECT qid, cand_id FROM candidates", share=0.5),
    "lsh_candidates_tight": sql(LSH, "SELECT qid, cand_id FROM candidates", share=0.02),
    "lsh_top10": sql(
        LSH + " lsh_ranked",
        "SELECT qid, id, rank::INTEGER AS rank, score FROM lsh_ranked WHERE rank <= 10",
        share=0.5,
    ),
    "lsh_predict": sql(
        LSH + " lsh_ranked",
        """SELECT batch.qid AS qid, predicted FROM batch LEFT JOIN
               (SELECT qid, round(avg(rating), 1) AS predicted FROM lsh_ranked WHERE rank <= 10 GROUP BY qid) AS m
           ON m.qid = batch.qid""",
        share=0.5,
    ),
    "lsh_predict_compat": sql(
        LSH + " lsh_ranked",
        """SELECT batch.qid AS qid, predicted FROM batch LEFT JOIN
               (SELECT qid, round(sum(rating) / 10, 1) AS predicted FROM lsh_ranked WHERE id_rank <= 10 GROUP BY qid) AS m
           ON m.qid = batch.qid""",
        share=0.5,
    ),
    "half_even_rounding": """SELECT p_partkey AS id, round_even(p_size / 2, 0) AS half_even, round(p_size / 2 / 10, 1) AS half_up FROM part""",
    "parse_lines": f"WITH {TIMED} SELECT id, round(predicted, 1) AS predicted FROM timed",
    "parse_tuples": f"WITH {TIMED} SELECT id, predicted, seconds FROM timed",
    "mean_seconds": f"WITH {TIMED} SELECT round(avg(seconds), 6) AS mean_seconds FROM timed",
    "column_summary": sql("catalog titles", " UNION ALL ".join(summary(c) for c in ("rating", "runtime", "votes"))),
    "distinct_counts": sql(
        "catalog titles",
        """SELECT list, count(DISTINCT token) AS n_distinct FROM (
               SELECT 'genres' AS list, unnest(genres) AS token FROM titles
               UNION ALL SELECT 'directors', unnest(directors) FROM titles
               UNION ALL SELECT 'writers', unnest(writers) FROM titles) AS t GROUP BY list""",
    ),
    "histogram10": sql("catalog titles", "").rstrip() + histogram("titles"),
    "histogram10_test": sql("catalog titles holdout", "").rstrip() + histogram("holdout"),
    "token_frequency": sql(
        "catalog titles",
        "SELECT token, count(*) AS n FROM (SELECT unnest(genres) AS token FROM titles) AS t GROUP BY token",
    ),
    "top20_makers": sql(
        "catalog titles director_counts", "SELECT token, n FROM director_counts ORDER BY n DESC, token LIMIT 20"
    ),
    "raw_maker_ranks": sql(
        "catalog",
        """SELECT directors AS value, count(*) AS n FROM catalog GROUP BY directors
           ORDER BY n DESC, value LIMIT 100 OFFSET 1""",
    ),
    "tsv_roundtrip": sql(
        "catalog",
        CATALOG_TEXT.replace("id, rating, votes", "id::VARCHAR AS id, rating, votes::INTEGER AS votes"),
    ),
}

PAIRS = """, pairs AS (
    SELECT batch.qid AS id, batch.rating AS actual, predicted
    FROM batch LEFT JOIN
        (SELECT qid, round(avg(rating), 1) AS predicted FROM lsh_ranked WHERE rank <= 10 GROUP BY qid) AS m ON m.qid = batch.qid)
"""
EVALUATED = sql(LSH + " lsh_ranked", "", share=0.5).rstrip() + PAIRS
SQL["rmse_mse"] = EVALUATED + """
    SELECT count(predicted) AS n, round(avg((predicted - actual) ** 2), 6) AS mse,
           round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse FROM pairs"""
SQL["confusion_matrix"] = EVALUATED + """
    SELECT a::INTEGER AS actual, p::INTEGER AS predicted,
           (SELECT count(*) FROM pairs WHERE round_even(actual, 0) = a AND round_even(predicted, 0) = p) AS n
    FROM range(11) AS r(a), range(11) AS s(p)"""
SQL["evaluate_saved_lines"] = SQL["rmse_mse"]
SQL["prediction_report"] = EVALUATED + """
    SELECT id::VARCHAR || chr(9) || 'actual ' || actual::VARCHAR || chr(9) || 'predicted '
           || coalesce(round(predicted, 6)::VARCHAR, 'NaN') AS value FROM pairs"""
SQL["array_report"] = EVALUATED + """
    SELECT list, value, count(*) AS n FROM (
        SELECT 'actual' AS list, actual::VARCHAR AS value FROM pairs
        UNION ALL SELECT 'predicted', round(predicted, 6)::VARCHAR FROM pairs) AS v GROUP BY list, value"""
SQL["tsv_one_file"] = SQL["tsv_roundtrip"]
SQL["cosine_top10_blocks"] = SQL["cosine_top10"]
SQL["distinct_sketch"] = SQL["distinct_counts"].replace("AS n_distinct FROM", "AS n_distinct, true AS within FROM")
SQL["quantile_sketch"] = """SELECT c AS "column", share::DOUBLE AS share, true AS within
    FROM (SELECT unnest(['rating', 'runtime', 'votes']) AS c), (SELECT unnest([0.25, 0.5, 0.75]) AS share)"""
SQL["lsh_store_predict"] = SQL["lsh_predict"]
SQL["lsh_store_compacted"] = SQL["lsh_top10"]
SQL["lsh_candidates_blocks"] = SQL["lsh_candidates"]
SQL["lsh_predict_blocks"] = SQL["lsh_predict"]
SQL["feature_tsv_roundtrip"] = SQL["feature_vector"].replace("SELECT id, (5", "SELECT id::VARCHAR AS id, (5")
SQL["attribute_top50_hard"] = attribute_ranked(
    "repeats", "true", "SELECT qid, id, rank::INTEGER AS rank, score FROM ranked WHERE rank <= 50", "hard_titles"
)
SQL["attribute_similarity_hard"] = sql(
    "catalog hard_titles",
    f"""SELECT id, other, round(genre_sim, 6) AS genre_sim, round({SCORE}, 6) AS score
        FROM (SELECT a.id AS id, b.id AS other,
                     {", ".join(f"{value} AS {name}" for name, value in attribute_parts("a", "b", "repeats").items())}
              FROM titles AS a JOIN titles AS b ON b.nth = a.nth + 1) AS p""",
)
SQL["cosine_hard"] = sql(
    "hard_vectors split",
    """SELECT batch.qid AS qid, predicted FROM batch LEFT JOIN (
           SELECT qid, round(avg(rating), 6) AS predicted
           FROM (SELECT qid, train.rating AS rating, row_number() OVER (PARTITION BY qid ORDER BY round(
                     list_dot_product(batch.v, train.v)
                     / (sqrt(list_dot_product(batch.v, batch.v)) * sqrt(list_dot_product(train.v, train.v))), 9) DESC, id) AS rank
                 FROM batch, train
                 WHERE list_dot_product(batch.v, batch.v) > 0 AND list_dot_product(train.v, train.v) > 0) AS r
           WHERE rank <= 10 GROUP BY qid) AS m ON m.qid = batch.qid""",
)
SQL["cosine_top10_pruned"] = sql(
    FEATURES + " feature_split",
    # every title, also those that share no position with the query
    """SELECT qid, id, rank::INTEGER AS rank, score FROM (
           SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
           FROM (SELECT b.qid AS qid, t.id AS id, coalesce(s.score, 0.0) AS score
                 FROM (SELECT qid FROM batch WHERE qid IN (SELECT id FROM norms WHERE norm > 0)) AS b,
                      (SELECT id FROM train WHERE id IN (SELECT id FROM norms WHERE norm > 0)) AS t
                 LEFT JOIN scored AS s ON s.qid = b.qid AND s.id = t.id) AS p) AS r
       WHERE rank <= 10""",
)
SQL["attribute_predict_text"] = attribute_ranked(
    "ratio",
    "c.kind LIKE 'ECONOMY%'",
    """, means AS (SELECT qid, sum(rating * (votes * score)) / sum(votes * score) AS predicted
                 FROM ranked WHERE rank <= 50 GROUP BY qid)
       SELECT title, count(*) AS asked, round(avg(predicted), 6) AS predicted
       FROM holdout LEFT JOIN means ON qid = id GROUP BY title""",
    holdout="asked",
    tie="'tt' || id::VARCHAR",  # ids are text there
)
FINE = {"planes": 60, "per": 12, "share": 0.5}
LSH_PREDICTED = """SELECT batch.qid AS qid, predicted FROM batch LEFT JOIN
    (SELECT qid, round(avg(rating), 1) AS predicted FROM lsh_ranked WHERE rank <= 10 GROUP BY qid) AS m
    ON m.qid = batch.qid"""
SQL["lsh_candidates_fine"] = sql(LSH, "SELECT qid, cand_id FROM candidates", **FINE)
SQL["lsh_predict_fine"] = sql(LSH + " lsh_ranked", LSH_PREDICTED, **FINE)
SQL["lsh_no_hit"] = sql(LSH + " lsh_ranked", LSH_PREDICTED, planes=60, per=20, share=0.5)


def recall(planes: int, per: int) -> str:
    hits = sql(
        LSH + " lsh_ranked exact",
        "SELECT count(*) FROM lsh_ranked AS l JOIN ranked AS r USING (qid, id) WHERE l.rank <= 10 AND r.rank <= 10",
        planes=planes,
        per=per,
        share=0.5,
    )
    total = sql("vectors split exact", "SELECT count(*) FROM ranked WHERE rank <= 10")
    return f"SELECT {planes}::INTEGER AS planes, 5::INTEGER AS bands, round(({hits}) / ({total}), 6) AS recall"


SQL["lsh_recall"] = recall(25, 5) + " UNION ALL " + recall(60, 12)

def probed(budget: float, body: str) -> str:
    """Flips of every key's bits by the distances of the flipped planes, the first 2000, as long as the budget lasts."""
    return sql(
        "vectors split planes signs banded",
        f""", far AS (
                SELECT id AS qid, k // {{per}} AS band, list(abs(x) ORDER BY k) AS d
                FROM (SELECT id, k, list_dot_product(v, p) AS x FROM vectors, planes WHERE id IN (SELECT qid FROM batch)) AS m
                GROUP BY id, k // {{per}}),
            flips AS (
                SELECT qid, f.band, xor(band_key, flip) AS band_key,
                       list_sum(list_transform(range({{per}}), lambda j: CASE WHEN (flip >> ({{per}} - 1 - j)) & 1 = 1
                                               THEN d[j + 1] ELSE 0.0::DOUBLE END)) AS cost
                FROM far AS f JOIN banded AS b ON b.id = f.qid AND b.band = f.band, range(1 << {{per}}) AS t(flip)),
            probes AS (
                SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cost, band, band_key) AS place FROM flips)
                WHERE place <= 2000),
            train_bands AS (SELECT id, band, band_key FROM banded WHERE id IN (SELECT id FROM train)),
            sizes AS (SELECT band, band_key, count(*) AS size FROM train_bands GROUP BY band, band_key),
            spent AS (
                SELECT *, sum(size) OVER (PARTITION BY qid ORDER BY place) AS spent,
                       row_number() OVER (PARTITION BY qid ORDER BY place) AS nth
                FROM probes JOIN sizes USING (band, band_key)),
            candidates AS (
                SELECT DISTINCT qid, id AS cand_id FROM spent JOIN train_bands USING (band, band_key)
                WHERE spent <= (SELECT count(*) FROM train) * {budget}::DOUBLE OR nth = 1)
            {body}""",
        planes=50,
        per=10,
    )


def probe_recall(budget: float) -> str:
    hits = sql("exact", "").strip().removeprefix("WITH")
    return probed(
        budget,
        f""", {hits}
            SELECT {budget}::DOUBLE AS budget,
                   round((SELECT count(*) FROM ranked JOIN candidates ON cand_id = id AND candidates.qid = ranked.qid WHERE rank <= 10)
                         / (SELECT count(*) FROM ranked WHERE rank <= 10), 6) AS recall,
                   round((SELECT count(*) FROM candidates) / ((SELECT count(*) FROM train) * (SELECT count(*) FROM batch)), 6) AS pair_share""",
    )


SQL["lsh_probe_candidates"] = probed(0.05, "SELECT qid, cand_id FROM candidates")
SQL["lsh_probe_recall"] = " UNION ALL ".join(f"SELECT * FROM ({probe_recall(b)})" for b in (0.05, 0.2, 0.6))
SQL["shuffled_split"] = SQL["split_test"]
SQL["title_text_join"] = sql(
    "catalog",
    """SELECT 'tt' || id::VARCHAR AS id, rating, votes::INTEGER AS votes,
              CASE WHEN kind LIKE 'ECONOMY%' THEN 'movie' ELSE 'tvMovie' END AS kind, title, flag, runtime,
              genres, directors, writers,
              (title IN (SELECT title FROM catalog WHERE kind LIKE 'ECONOMY%'))::INTEGER AS asked
       FROM catalog WHERE kind LIKE 'ECONOMY%' OR kind LIKE 'SMALL%'""",
)


def counted_bins(part: str, where: str) -> str:
    return f"""
        SELECT 'histogram_{part}' AS summary, i::VARCHAR AS name,
               (SELECT count(*) FROM titles, (SELECT min(rating) AS lo, max(rating) AS hi FROM titles WHERE {where}) AS b
                WHERE {where} AND (SELECT max(j) FROM range(10) AS u(j) WHERE lo + j * ((hi - lo) / 10) <= rating) = i) AS number
        FROM range(10) AS t(i)"""


SQL["profile_all"] = sql(
    "catalog titles director_counts",
    " UNION ALL ".join(
        [
            *[f"SELECT 'summary' AS summary, '{c}' AS name, count({c}) AS number FROM titles" for c in ("rating", "runtime", "votes")],
            "SELECT 'flagged', 'flag', count(*) FILTER (WHERE flag = 1) FROM titles",
            *[
                f"SELECT 'distinct', '{c}', count(DISTINCT token) FROM (SELECT unnest({c}) AS token FROM titles) AS t"
                for c in ("genres", "directors", "writers")
            ],
            "SELECT 'genre_frequency', token, count(*) FROM (SELECT unnest(genres) AS token FROM titles) AS t GROUP BY token",
            "SELECT * FROM (SELECT 'top_directors', token, n FROM director_counts ORDER BY n DESC, token LIMIT 20) AS t",
            """SELECT * FROM (SELECT 'raw_directors', directors AS value, count(*) AS n FROM catalog GROUP BY directors
               ORDER BY n DESC, value LIMIT 100 OFFSET 1) AS t""",
            counted_bins("all", "true"),
            counted_bins("train", "nth % 4 <> 0"),
            counted_bins("test", "nth % 4 = 0"),
        ]
    ),
)
