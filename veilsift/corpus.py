"""A corpus with credential-shaped texts, derived from orders by an expression that Spark and DuckDB both read.

The driver's tables hold hardly any credentials, so the queries of the rule table run on these. Prefixes and bodies are
put together in the query; no credential-shaped literal stands here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Texts by o_orderkey modulo their number; h, g: hex digests, H: h in capitals, q: a double quote, n: a line feed.
TEMPLATES = (
    "'aws_access_key_id = ' || q || 'AK' || 'IA' || substr(H, 1, 16) || q",
    "'aws_secret_access_key = ' || q || substr(h, 1, 40) || q",
    "'openai_api_key=' || q || 's' || 'k-' || substr(h, 1, 48) || q || n || 'done'",
    "'key: ' || 's' || 'k-pro' || 'j-' || substr(h, 1, 40)",
    "'first' || n || 'github_token = ' || 'gh' || 'p_' || substr(h, 1, 36)",
    "'export GH=' || 'gh' || 's_' || substr(g, 1, 36)",
    "'stripe_key => ' || q || 's' || 'k_li' || 've_' || substr(h, 1, 24) || q",
    "'test_key: ' || 'r' || 'k_te' || 'st_' || substr(h, 1, 20) || ' end'",
    "'hook ' || 'https://hooks' || '.slack.com/services/' || 'T' || substr(H, 1, 9) || '/B' || substr(H, 10, 9) || '/' || substr(h, 20, 24)",
    "'-----BEGIN RSA ' || 'PRIVATE KEY-----' || n || h || n || g || n || '-----END RSA ' || 'PRIVATE KEY-----'",
    "'DATABASE_URL = ' || q || 'post' || 'gres://user:' || substr(h, 1, 20) || '@db.host/app' || q",
    "'SIGNING_HMAC = ' || q || substr(h, 1, 21) || '-' || substr(g, 1, 19) || q",
    "'pair = ' || q || 'gh' || 'p_' || substr(h, 1, 36) || ' ' || 'gh' || 'r_' || substr(g, 1, 36) || q",
    "'pad = ' || q || '  ' || 'gh' || 'o_' || substr(h, 1, 36) || '  ' || q || n || 'again ' || 'gh' || 'o_' || substr(h, 1, 36)",
    "'password = ' || q || 'changeme-' || substr(h, 1, 30) || q || ' # token = ' || q || substr(g, 1, 40) || q",
    "'open ' || q || substr(h, 1, 30) || n || 'x == ' || substr(g, 1, 24) || n || 'v = ' || substr(h, 3, 28) || ' ' || q || chr(36) || chr(123) || h || chr(125) || q",
)


def corpus_sql(duckdb: bool) -> str:
    """SELECT unit_id, path, text."""
    sha = (lambda x: f"sha256({x})") if duckdb else (lambda x: f"sha2({x}, 256)")
    key = "CAST(o_orderkey AS VARCHAR)" if duckdb else "CAST(o_orderkey AS STRING)"
    text = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES))
    return (
        f"SELECT unit_id, path, CASE unit_id % {len(TEMPLATES)} {text} END AS text FROM ("
        f"SELECT o_orderkey AS unit_id, 'orders/' || {key} AS path, {sha(key)} AS h, {sha(f'{key} || chr(46)')} AS g, upper({sha(key)}) AS HH, chr(34) AS q, chr(10) AS n FROM orders)"
    ).replace("substr(H,", "substr(HH,")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(corpus_sql(False).replace("FROM orders)", "FROM {orders})"), orders=orders)
