"""Registered queries of the thirteen operators and the pipeline, and their SQL where SQL can express them."""
from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from .audit import audit_filters, orders_of
from .bpe import encode_bpe
from .common import documents, vocabulary
from .decontaminate import contaminated
from .language import predict_language, train_language_model
from .neighbors import vector_components
from .pii import find_pii
from .pieces import encode, load_model
from .quality import score_quality, train_quality_model
from .repeats import remove_repeats
from .shards import shard_digest
from .simhash import simhash_components
from .tokenfile import token_file_digest
from .vafile import cluster_vectors


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(documents(spark, folder))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_file_digest(documents(spark, folder), f.read())


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to."""
    encoded = encode(documents(spark, folder), load_model(vocabulary("piece_bpe_32k.model")))
    return encoded.select("doc_id", "ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_quality(docs, train_quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(documents(spark, folder)).drop("found")


def op8_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_components(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return predict_language(docs, train_language_model(docs))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_digest(documents(spark, folder))


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        encoded = encode_bpe(documents(spark, folder), f.read())
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", "n_tokens", F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_repeats": op2_repeats,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_vectors": op8_vectors,
    "op9_language": op9_language,
    "op10_shards": op10_shards,
    "op11_bpe": op11_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}
_FOUND = """SELECT doc_id, '{kind}' AS kind, {place} AS place, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM t"""
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _rounds_sql(rounds: int = 10, k: int = 8) -> str:
    """Centroid rounds as one chain of named queries over (vector, dimension, value) rows."""
    nearest = """a{i} AS MATERIALIZED (SELECT vec_id, c, dist FROM (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS dist
        FROM v JOIN c{i} m ON v.d = m.d GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)"""
    mean = """c{j} AS MATERIALIZED (SELECT c{i}.c, c{i}.d, CASE WHEN s.n IS NULL THEN c{i}.x ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS x
        FROM c{i} LEFT JOIN (SELECT a.c, v.d, count(*) AS n, sum(v.x)::BIGINT AS total FROM a{i} a JOIN v ON a.vec_id = v.vec_id GROUP BY 1, 2) s
        ON c{i}.c = s.c AND c{i}.d = s.d)"""
    steps = [nearest.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    return f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
        v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, floor(1024 * unnest(x))::BIGINT AS x FROM e),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < {k}),
        c0 AS MATERIALIZED (SELECT f.c, v.d, v.x FROM f JOIN v ON f.vec_id = v.vec_id), """ + ", ".join(steps) + f""",
        h AS (SELECT c, sha256(string_agg(cast(x AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY 1)
        SELECT a.vec_id, a.c::INTEGER AS cluster, a.dist::BIGINT AS distance, (sum(a.dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
            (sum(a.dist) OVER ())::BIGINT AS inertia, h.digest AS centroid_sha256 FROM a{rounds} a JOIN h ON a.c = h.c"""


_STEPS = ", ".join(f"('{order}', {step}, {bit}, {before})" for order, step, bit, before in orders_of("ABCDE"))
#: SQL for what it can express on whole tables. The added kinds of personal data need look-around, which the
#: SQL side lacks, so ``spans`` has base kinds only there; hashes, classifiers, tokenizers and shuffles have
#: no SQL form and are tested against plain versions.
ORACLES: dict[str, str] = {
    "op2_repeats": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        least AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN least USING (k), (SELECT unnest(range(13)) AS o) WHERE least < doc_id),
        tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS s, count(*) AS n FROM tok t
            LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p WHERE g.p IS NULL GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op7_pii": "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
        + " UNION ALL ".join(_FOUND.format(kind=k, place=i, pattern=x) for i, (k, x) in enumerate(_BASE.items())) + r"""),
        s AS (SELECT doc_id, kind, place, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda k:
            list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))) AS a FROM f),
        d AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM s),
        l AS (SELECT *, list_transform(range(length(digits)), lambda i: cast(digits[length(digits) - i] AS INT) * (1 + i % 2)) AS luhn FROM d),
        ok AS (SELECT * FROM l WHERE CASE kind
            WHEN 'email' THEN true
            WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0
            WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(luhn, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0
            ELSE length(digits) BETWEEN 9 AND 15 END),
        j AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _BASE) + r""",
            string_agg(kind || ':' || cast(a AS BIGINT) || ':' || cast(a + length(m) AS BIGINT), ',' ORDER BY place, a) AS spans FROM ok GROUP BY 1)
        SELECT t.doc_id, """ + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE) + """, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN j ON t.doc_id = j.doc_id""",
    "op8_vectors": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM e JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op12_filter_audit": rf"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
        m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (len(ws) < 100)::INT + 2 * (100 * list_unique(ws) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
        s(filter_order, step, bit, before) AS (VALUES {_STEPS}),
        o AS (SELECT part, filter_order, step, bit,
            sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM c CROSS JOIN s GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM o""",
    "op13_centroids": _rounds_sql(),
}
