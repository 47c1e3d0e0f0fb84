"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, langid, licenses, neardup, pieces, pii, quality, repeats, shards, tokenbin, warc, yinyang
from .kernels import Scratch, read


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents")).drop("lang")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("longest", "item_id", "item_word", "doc_word")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), pieces.Pieces.load())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), f"{scratch.root}/archive")
    records = scratch.keep(warc.read_records(spark, f"{scratch.root}/archive", payloads=False), "records")
    return warc.digest(warc.assemble(records))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(codes.compress(read(spark, sf_dir, "embeddings")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = f"{Scratch(spark, 'token-files').root}/ids"
    tokenbin.write(read(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenbin.digest(spark, root)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.digest(yinyang.cluster(read(spark, sf_dir, "embeddings")))


QUERIES = {
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_warc": op6_warc,
    "op8_sharding": op8_sharding,
    "op10_license_scan": op10_license_scan,
    "op1_language_id": op1_language_id,
    "op3_pii": op3_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
    "op13_centroid_clusters": op13_centroid_clusters,
}

SQL: dict[str, str] = {}

#: Tokens and windows spelled out; longest matches and places have no short SQL and are tested by brute force.
SQL["op2_decontamination"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
sizes AS (SELECT DISTINCT n FROM k),
grams AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, w, s.n AS n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, sizes s WHERE len(w) >= s.n)),
hits AS (SELECT grams.r, grams.i, grams.n, wins.item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.n = wins.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m FROM p WHERE strlen(h) >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

SQL["op4_minhash_near_dedup"] = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (r) JOIN c USING (r)
"""


def _pii_sql() -> str:
    """The contract's patterns as they stand, run by RE2; the added kinds with word boundaries."""
    octet = "(CAST(x AS HUGEINT) <= 255)"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "secret": pii.SECRET, "local_phone": r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INT) WHEN CAST(reverse({digits})[i] AS INT) > 4 THEN 2 * CAST(reverse({digits})[i] AS INT) - 9 ELSE 2 * CAST(reverse({digits})[i] AS INT) END)) % 10 = 0"
    bare = "replace(v, ' ', '')"
    mod97 = f"list_reduce(list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: CAST(CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT)), lambda a, b: (CASE WHEN b < 10 THEN a * 10 ELSE a * 100 END + b) % 97, CAST(0 AS BIGINT)) = 1"
    words = {k.name: k.context for k in pii.KINDS}
    near = lambda k: f"regexp_matches(right(a, 40) || chr(10) || left(b, 40), '(?i)(?:^|[^a-z])(?:{words[k]})')"
    valid = {
        "email": "true", "ip": f"len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 3) AS INT) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 9 AND 15", "iban": mod97, "ssn": near("ssn"), "secret": "true", "local_phone": near("local_phone"),
    }
    parts = []
    for i, (k, p) in enumerate(patterns.items()):
        q = p.replace("'", "''")
        parts.append(
            f"SELECT r, {i} AS o, '{k}' AS kind, s, s + len(v) AS e FROM (SELECT r, m[i] AS v, p[i] AS a, p[i + 1] AS b, len(array_to_string(p[1:i], '')) + len(array_to_string(m[1:i-1], '')) AS s "
            f"FROM (SELECT r, m, string_split_regex(t, '{q}') AS p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{q}') AS m FROM d))) WHERE {valid[k]}"
        )
    line = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, string_agg({line}, ',' ORDER BY o, s) FILTER (o < 4) AS base, string_agg({line}, ',' ORDER BY o, s) AS spans, count(*) AS n_spans FROM f GROUP BY r)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans FROM d LEFT JOIN g USING (r)"""


SQL["op3_pii"] = _pii_sql()


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """Plain Lloyd rounds, each from all vectors; distances are sums of doubles that are integers below 2**53."""
    sql = [f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, list_slice(v, {width} * p + 1, {width} * p + {width}) AS x FROM w, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM w QUALIFY e < {entries}) JOIN v USING (r))"""]
    for k in range(rounds + 1):
        sql.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM v JOIN c{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            sql.append(
                f"s{k} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(CAST(y AS HUGEINT)) / count(*)) AS f FROM (SELECT v.p, m % 256 AS e, unnest(x) AS y, unnest(range({width})) AS i FROM v JOIN a{k} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e), "
                f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} USING (p, e))"
            )
    last = f"a{rounds}"
    sql.append(f"f AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM {last} GROUP BY r)")
    sql.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, unnest(range({width})) AS i FROM c{rounds}))")
    return ",\n".join(sql) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN f USING (r), h"


SQL["op11_vector_codes"] = _codes_sql()


def _clusters_sql(clusters: int = 16, rounds: int = 3, width: int = 64) -> str:
    sql = [f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS e, x AS c FROM w QUALIFY e < {clusters})"""]
    for k in range(rounds + 1):
        sql.append(f"a{k} AS MATERIALIZED (SELECT r, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM w, c{k} GROUP BY r)")
        if k < rounds:
            sql.append(
                f"s{k} AS (SELECT e, list(f ORDER BY i) AS c FROM (SELECT e, i, floor(sum(CAST(y AS HUGEINT)) / count(*)) AS f FROM (SELECT m % 256 AS e, unnest(x) AS y, unnest(range({width})) AS i FROM w JOIN a{k} USING (r)) GROUP BY e, i) GROUP BY e), "
                f"c{k + 1} AS MATERIALIZED (SELECT e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} USING (e))"
            )
    sql.append(f"f AS (SELECT vec_id, CAST(m % 256 AS INTEGER) AS cluster, CAST(m // 256 AS BIGINT) AS distance FROM w JOIN a{rounds} USING (r))")
    sql.append(f"h AS (SELECT e, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM (SELECT e, unnest(c) AS y, unnest(range({width})) AS i FROM c{rounds}) GROUP BY e)")
    return ",\n".join(sql) + "\nSELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN h ON e = cluster"


SQL["op13_centroid_clusters"] = _clusters_sql()
