"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.llm.common import is_held_out, picked, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~is_held_out("doc_id")), table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    from affinara.llm import packing

    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import nn_descent

    return nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import top_k

    vectors = top_k.whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k.search(vectors, vectors.where("id % 50 = 0"), k=5)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import main_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.main_text(pages, main_text.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import near_dedup

    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~is_held_out("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import licences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.fit(licences.sample_paragraphs(docs)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import bpe

    docs = picked(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    encoded = bpe.encode(docs, tokenizer_path()).drop("text")
    both = bpe.decode(encoded, tokenizer_path())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import suffix_dedup

    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import token_store

    return token_store.stored_directory(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinara.llm import repair

    rows = table(spark, sf_dir, "conversations")
    return repair.summaries(repair.damaged(rows), rows)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_nn_descent, op4_top_k, op5_main_text, op6_near_dedup, op7_language, op8_licences, op9_bpe, op10_suffix_dedup, op11_lexical, op12_token_store, op13_repair)}
SQL: dict[str, str] = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_lexical": r"""
        WITH d AS (
            SELECT row_number() OVER () AS place, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), total AS (
            SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms
            FROM d WHERE len(terms) > 0
        ), asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(
                             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL
        ), tf AS (
            SELECT place, doc_id, n, term, count(*) AS tf
            FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM asked)
            GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, total GROUP BY term, n_docs
        ), s AS (
            SELECT item_id, place, doc_id,
                   CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN tf USING (term) JOIN w USING (term), total
            GROUP BY ALL
        ), r AS (
            SELECT item_id, doc_id, score,
                   CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
            FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_repair": r"""
        WITH RECURSIVE source AS (
            SELECT row_number() OVER () AS place, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), hashed AS (
            SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                          lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END),
                          CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
            FROM source
        ), damaged AS (
            SELECT place, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM hashed WHERE kind <> 0
        ), numbered AS (
            SELECT conv_id, turn, role, text, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), place, copy) - 1 AS i,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM damaged
        ), met AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous
            FROM numbered
        ), faulty AS (
            SELECT *, final = '' AS is_blank, final <> '' AND again AS is_duplicate,
                   final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS is_truncated
            FROM met
        ), priced AS (
            SELECT *, CASE WHEN is_blank OR is_duplicate THEN 1000000000 WHEN is_truncated THEN 5 ELSE 0 END AS stay
            FROM faulty
        ), back AS (
            SELECT conv_id, n AS i, CAST(0 AS BIGINT) AS v0, CAST(10 AS BIGINT) AS v1, CAST(5 AS BIGINT) AS v2, CAST(0 AS BIGINT) AS v3
            FROM priced WHERE i = 0
            UNION ALL
            SELECT conv_id, i, least(w0, least(w2, w3 + 5) + 5), least(w1, least(w2, w3 + 5) + 5), least(w2, w3 + 5), least(w3, w2 + 5)
            FROM (
                SELECT p.conv_id, p.i,
                       least(v0 + 2, v2 + stay + 1, CASE initial WHEN 's' THEN v1 + stay WHEN 'u' THEN v2 + stay ELSE v0 + 2 END) AS w0,
                       least(v1 + 2, v2 + stay + 1, CASE initial WHEN 'u' THEN v2 + stay ELSE v1 + 2 END) AS w1,
                       least(v2 + 2, v3 + stay + 1, CASE initial WHEN 'a' THEN v3 + stay ELSE v2 + 2 END) AS w2,
                       least(v3 + 2, v2 + stay + 1, CASE initial WHEN 'u' THEN v2 + stay ELSE v3 + 2 END) AS w3
                FROM back JOIN priced AS p ON p.conv_id IS NOT DISTINCT FROM back.conv_id AND p.i = back.i - 1
            )
        ), vectors AS (
            SELECT b.conv_id, b.i, [v0, v1, v2, v3] AS v, lead([v0, v1, v2, v3]) OVER (PARTITION BY b.conv_id ORDER BY b.i) AS w,
                   p.role, p.text, p.initial, p.stay
            FROM back AS b LEFT JOIN priced AS p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i
        ), ahead AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, FALSE AS ended
            FROM priced WHERE i = 0
            UNION ALL
            SELECT conv_id, i + CASE WHEN letter IN ('I', '') THEN 0 ELSE 1 END,
                   CASE WHEN letter = 'D' OR letter = '' THEN q
                        WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
                        ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END,
                   audit || letter,
                   CASE letter WHEN 'I' THEN list_append(lines, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END)
                               WHEN 'K' THEN list_append(lines, role || ':' || text)
                               WHEN 'R' THEN list_append(lines, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)
                               ELSE lines END,
                   letter = ''
            FROM (
                SELECT a.*, t.role, t.text, t.initial,
                       CASE WHEN t.w IS NOT NULL AND t.v[q + 1] = t.w[q + 1] + 2 THEN 'D'
                            WHEN t.v[q + 1] = t.v[CASE q WHEN 2 THEN 4 ELSE 3 END] + 5 THEN 'I'
                            WHEN t.w IS NULL THEN ''
                            WHEN (initial = 's' AND q = 0 AND t.v[1] = t.w[2] + stay)
                              OR (initial = 'u' AND q <> 2 AND t.v[q + 1] = t.w[3] + stay)
                              OR (initial = 'a' AND q = 2 AND t.v[3] = t.w[4] + stay) THEN 'K'
                            ELSE 'R' END AS letter
                FROM ahead AS a JOIN vectors AS t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.i = a.i
                WHERE NOT a.ended
            )
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
                   count(*) FILTER (is_truncated) AS truncated,
                   count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM priced GROUP BY conv_id
        )
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS o
        LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.blank IS NOT NULL
        LEFT JOIN (SELECT * FROM vectors WHERE i = 0) AS t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN (SELECT * FROM ahead WHERE ended) AS a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
