"""SQL-callable functions: `register` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docquarry.sources.files import hash63, sha3_256

#: Written in SQL, so that they stay in generated code.
SCALAR = {
    "dq_label": "(source string, lang string) returns string return concat(upper(source), '/', lang)",
    "dq_slug": "(name string) returns string return substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_'), '^_+|_+$', ''), 1, 48)",
    "dq_size_bucket": "(size bigint) returns string return case when size < 0 then 'unknown' when size < 1000 then 'small' when size < 1000000 then 'medium' else 'large' end",
}
TABLES = {
    "dq_doubled": "(n bigint) returns table (doubled bigint) return select n * 2",
    "dq_lines": "(text string) returns table (line_number int, line string) return select pos + 1, col from posexplode(split(text, '\\n'))",
}


def register(spark: SparkSession) -> list[str]:
    """Register the functions and give their names."""
    for name, body in (SCALAR | TABLES).items():
        spark.sql(f"create or replace temporary function {name}{body}")
    spark.udf.register("dq_hash63", hash63)
    spark.udf.register("dq_sha3_256", sha3_256)
    return [*SCALAR, *TABLES, "dq_hash63", "dq_sha3_256"]
