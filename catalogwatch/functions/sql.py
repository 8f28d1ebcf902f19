"""The commonest expressions as named SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "cw_number(x STRING) RETURNS DOUBLE":
        r"try_cast(regexp_extract(replace(replace(trim(x), ' ', ''), ',', '.'), r'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$', 0) AS DOUBLE)",
    "cw_clean_text(x STRING) RETURNS STRING": "nullif(trim(x), '')",
    "cw_strip_url(x STRING) RETURNS STRING": r"nullif(regexp_replace(regexp_replace(trim(x), r'[#?][\s\S]*$', ''), r'/+$', ''), '')",
    "cw_domain(x STRING) RETURNS STRING":
        r"nullif(regexp_replace(lower(trim(x)), r'^www\.', ''), '')",
    "cw_host(x STRING) RETURNS STRING":
        r"nullif(lower(regexp_extract(x, r'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^:@/?#]*)', 1)), '')",
    "cw_path_segments(x STRING) RETURNS INT":
        r"size(filter(split(regexp_extract(x, r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), s -> s <> ''))",
    "cw_clean_price(x STRING) RETURNS DOUBLE":
        r"nullif(least(try_cast(regexp_extract(regexp_replace(regexp_replace(regexp_replace(x, r'[€$£¥₽\s]', ''), r'^([^.,]*),(\d{1,2})$', '$1.$2'), "
        r"r'\G([^.,]*),(?=[^.]*$)', '$1'), r'\d+(?:\.\d{1,2})?', 0) AS DOUBLE), 1000000.5), 1000000.5)",
    "cw_mean_share(n BIGINT, total BIGINT) RETURNS DOUBLE": "coalesce(try_divide(CAST(n AS DOUBLE), CAST(total AS DOUBLE)), 0.0D)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    return names
