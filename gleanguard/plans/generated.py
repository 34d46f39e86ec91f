"""A generated corpus: text with fake secrets made from a table's keys, the same in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: {k} is the key, {hN} and {HN} the first N hexadecimal digits of its hash, lower and upper case; {b} base64 text.
TEMPLATES = (
    "AWS_ACCESS_KEY_ID=AKIA{H16}\naws_secret_access_key = '{h32}{h8}'\naws account_id: {k}00\n",
    "DATABASE_URL=postgres://u{k}:{h12}@db{k}.internal:5432/app\nmysql://root:{h8}@host/x\nredis://a:x{h8}@cache/0\njdbc:mysql://u:{h8}@db/y\n",
    "token: ghp_{h32}{h8}\n# secret: ignore\nGITHUB=ghp_{h32}{h4}\n1\n2\n3\nGITHUB=ghp_{h32}{h8}\nx = {h32}{h8} # secrets : ignore(github-oauth-token, other)\n",
    "Authorization: Bearer eyJ{h20}.eyJ{h20}.{h20}\naccess_token=eyJ{h20}.eyJ{h20}\n",
    "-----BEGIN RSA PRIVATE KEY-----\n{h32}\n{h32}\n-----END RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----\n",
    "  sk_live_{h32}\nxoxb-{k}-{h16}\nhttps://hooks.slack.com/services/T{H8}/B{H8}/{h24}\n",
    "key AIza{h32}abc\n123456789012-{h32}.apps.googleusercontent.com\nsvc{k}@p.iam.gserviceaccount.com\n",
    "API_KEY='{h20}'  # nosec\nx\ny\nz\nAPI_KEY={h20}\nSECRET=1\nKEY={h32}{h8}\n",
    "DefaultEndpointsProtocol=https;AccountName=a{k};AccountKey={h32}==;EndpointSuffix=x\nsv=2020-01-01&sig={h20}\nclient_secret={h32}{h4}\n",
    "data {b} end\n",
    "äöü {h8}\npassword: ünïcode{h12} \n sessionid={h24}\n",
    "nothing to see here {k}\n",
    "npm_{h32}{h4}\nSG.{h22}.{h32}{h11}\nkey-{h32}\nSK{h32}\nAC{h32}\nglpat-{h20}\n",
    "api_key = aB3{h12}XyZ{H12}QwE9\nvalue aB3{h12}XyZ{H12}QwE9rT\n",
)
EXTENSIONS = ("", ".py", ".md", ".json", ".txt", ".lock", ".env")
PLAIN_RUN = "aws AKIA{H16} {h7} end"  # as base64: 36 bytes, so without padding


def _parts(template: str) -> list[tuple[str, int]]:
    return [(p, 0) if k % 2 == 0 else (p[0], int(p[1:] or 0)) for k, p in enumerate(re.split(r"\{(\w+)\}", template))]


def _column(template: str, key: Column) -> Column:
    h = F.md5(key)
    out = []
    for k, (p, n) in enumerate(_parts(template)):
        out.append(F.lit(p) if k % 2 == 0 else key if p == "k" else F.base64(F.encode(_column(PLAIN_RUN, key), "UTF-8")) if p == "b" else F.substring(h if p == "h" else F.upper(h), 1, n))
    return F.concat(*out)


def _sql(template: str) -> str:
    out = []
    for k, (p, n) in enumerate(_parts(template)):
        if k % 2 == 0:
            if p:
                out.append("'" + p.replace("'", "''") + "'")
        elif p == "k":
            out.append("k")
        elif p == "b":
            out.append(f"base64(encode({_sql(PLAIN_RUN)}))")
        else:
            out.append(f"substr({'md5(k)' if p == 'h' else 'upper(md5(k))'}, 1, {n})")
    return " || ".join(out)


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer splits than there are cores, as small ones of one file have, dealt to all of them; larger ones
    stay in their files' splits and nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of every customer."""
    key = F.col("c_custkey").cast("string")
    number = F.col("c_custkey")
    content = F.coalesce(*(F.when(number % len(TEMPLATES) == k, _column(t, key)) for k, t in enumerate(TEMPLATES)))
    end = F.coalesce(*(F.when(number % len(EXTENSIONS) == k, F.lit(e)) for k, e in enumerate(EXTENSIONS)))
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select(F.concat(F.lit("src/"), key, end).alias("path"), content.alias("content"))


def generated_sql() -> str:
    content = " ".join(f"WHEN n % {len(TEMPLATES)} = {k} THEN {_sql(t)}" for k, t in enumerate(TEMPLATES))
    end = " ".join(f"WHEN n % {len(EXTENSIONS)} = {k} THEN '{e}'" for k, e in enumerate(EXTENSIONS))
    return f"SELECT 'src/' || k || CASE {end} END AS path, CASE {content} END AS content FROM (SELECT c_custkey AS n, CAST(c_custkey AS VARCHAR) AS k FROM customer)"
