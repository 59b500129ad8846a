"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import cotrain, decontaminate, exact_dedup, html_extract, kd_shards, license_scan, neardup, pii_disclosure, piece_codec, url_filters
from siltlog.llm.frames import read_table


#: A dated block list: list_name, key, listed_at, action, verdict.
LIST_ENTRIES = (
    ("abuse", "spam-farm.example.org", "2024-01-15", "add", "block"),
    ("abuse", "spam-farm.example.org", "2024-05-01", "drop", "block"),
    ("abuse", "spam-farm.example.org", "2024-07-20", "add", "block"),
    ("abuse", "cheap-pills.example.com", "2024-02-01", "add", "block"),
    ("abuse", "cheap-pills.example.com", "2024-10-10", "add", "allow"),
    ("appeals", "spam-farm.example.org/en", "2024-08-01", "add", "allow"),
    ("appeals", "spam-farm.example.org/en", "2024-11-01", "drop", "allow"),
    ("appeals", "www.cheap-pills.example.com", "2024-06-01", "add", "allow"),
    ("appeals", "www.cheap-pills.example.com", "2024-06-21", "drop", "allow"),
    ("regional", "example.net", "2024-03-01", "add", "block"),
    ("regional", "example.net", "2024-03-15", "drop", "block"),
    ("regional", "tionsh.example.net", "2024-03-05", "add", "allow"),
    ("mirrors", "blog.tionsh.example.net/en", "2024-01-01", "add", "block"),
    ("mirrors", "blog.tionsh.example.net/en", "2024-09-30", "drop", "block"),
    ("mirrors", "example.org", "2024-12-01", "add", "block"),
    ("typos", "tionsh.example.nett", "2024-01-01", "add", "block"),
)
#: The pages carry no fetch time: page_id gives the day of 2024 on which each counts as fetched.
_FETCHED = "timestampadd(DAY, CAST(pmod(page_id * 37, 366) AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS fetched_at"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = read_table(spark, sf_dir, "pages").selectExpr("page_id", "url", _FETCHED)
    listed = spark.createDataFrame(LIST_ENTRIES, "list_name string, key string, listed_at string, action string, verdict string")
    return url_filters.filter_captures(captures, listed.withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = kd_shards.kd_shards(read_table(spark, sf_dir, "documents"), shards=16)
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tiles")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.protect(read_table(spark, sf_dir, "documents")).drop("terms")


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_license_scans": op2_license_scans,
    "op3_html_extraction": op3_html_extraction,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"
_VALUES = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c} 00:00:00', '{d}', '{e}')" for a, b, c, d, e in LIST_ENTRIES)

ORACLES = {
    "op1_url_filters": f"""
        WITH e(list_name, key, listed_at, action, verdict) AS (VALUES {_VALUES}),
        a0 AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id * 37 % 366 AS INTEGER)) AS fetched_at,
                     lower(regexp_extract(url, '{_HOST}', 1)) AS host, lower(regexp_extract(url, '{_PATH}', 1)) AS path FROM pages),
        c AS (SELECT DISTINCT * FROM a0),
        latest AS (SELECT c.page_id, c.url, c.fetched_at, e.*, row_number() OVER (PARTITION BY c.page_id, c.url, e.list_name, e.key ORDER BY e.listed_at DESC) AS r
                   FROM c JOIN e ON e.listed_at <= c.fetched_at AND (e.key = host OR ends_with(host, '.' || e.key) OR e.key = host || '/' || path OR starts_with(host || '/' || path, e.key || '/') AND contains(e.key, '/'))),
        active AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC, verdict, list_name) AS best, count(*) OVER (PARTITION BY page_id, url) AS n
                   FROM latest WHERE r = 1 AND action = 'add')
        SELECT c.page_id, c.url, c.fetched_at, coalesce(a.verdict, 'none') AS verdict, a.key AS matched_key, a.list_name, a.listed_at AS valid_from, coalesce(a.n, 0) AS n_active
        FROM a0 c LEFT JOIN active a ON a.page_id = c.page_id AND a.url = c.url AND a.best = 1
    """,
    "op7_minhash_neardup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
        m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
}
