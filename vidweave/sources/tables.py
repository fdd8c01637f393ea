"""Views of the given tables as the transcript tables that the operators work on.

Each adapter takes (spark, sf_dir) and returns a DataFrame; each has its twin as a DuckDB common table
expression in CTES, so that queries and oracles start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("video_id"), F.substring("source", 4, 9).cast("long").alias("user_id"), F.md5("text").alias("md5"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("original_name"), F.col("n_chars").alias("file_size_bytes"),
        F.when(F.col("doc_id") % 3 == 0, "PROCESSING").otherwise("READY").alias("status"), (F.col("n_chars") * 10).alias("duration_ms"), "lang",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    index = F.col("i").cast("long")
    return d.where(F.trim("content") != "").select((F.col("video_id") * 100000 + index).alias("id"), "video_id", index.alias("segment_index"), (index * 1000).alias("start_ms"), (index * 1000 + 1000).alias("end_ms"), "content")


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One base for each user and a second family of seven, of user kb_id."""
    v = videos(spark, sf_dir)
    own = v.select(F.col("user_id").alias("kb_id"), "user_id").distinct()
    return own.union(spark.range(7).select((F.col("id") + 1000).alias("kb_id"), F.col("id").alias("user_id")))


def kb_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir)
    return v.select(F.col("user_id").alias("kb_id"), "video_id").union(v.where("video_id % 2 = 0").select((F.col("video_id") % 7 + 1000).alias("kb_id"), "video_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions over every video of one user."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 20).alias("user_id"), F.col("text").alias("question"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("video_id"), "role", F.col("text").alias("content"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "DONE").otherwise("RUNNING")
    return o.select(F.col("o_orderkey").cast("long").alias("job_id"), F.col("o_custkey").cast("long").alias("video_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 50).cast("long").alias("user_id"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload parts, the last write of each (session, part) by a total order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long").alias("session_id"), (F.col("l_linenumber") - 1).cast("long").alias("part_number"), F.col("l_quantity").cast("long").alias("size_bytes"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("written"))


#: Fixed forms of the adapters in DuckDB SQL.
CTES: dict[str, str] = {
    "videos": """videos AS (SELECT doc_id AS video_id, CAST(substr(source, 4) AS BIGINT) AS user_id, md5(text) AS md5, 'doc-' || doc_id AS original_name,
  n_chars AS file_size_bytes, CASE WHEN doc_id % 3 = 0 THEN 'PROCESSING' ELSE 'READY' END AS status, n_chars * 10 AS duration_ms, lang FROM documents)""",
    "segments": """segments AS (SELECT video_id * 100000 + i - 1 AS id, video_id, i - 1 AS segment_index, (i - 1) * 1000 AS start_ms, i * 1000 AS end_ms, content FROM (
  SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(content) <> '')""",
    "knowledge_bases": """knowledge_bases AS (SELECT DISTINCT user_id AS kb_id, user_id FROM videos UNION ALL SELECT range + 1000, range FROM range(7))""",
    "kb_videos": """kb_videos AS (SELECT user_id AS kb_id, video_id FROM videos UNION ALL SELECT video_id % 7 + 1000, video_id FROM videos WHERE video_id % 2 = 0)""",
    "questions": """questions AS (SELECT item_id AS question_id, item_id % 20 AS user_id, text AS question FROM benchmark)""",
    "messages": """messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS video_id, role, text AS content FROM conversations)""",
    "jobs": """jobs AS (SELECT CAST(o_orderkey AS BIGINT) AS job_id, CAST(o_custkey AS BIGINT) AS video_id,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'DONE' ELSE 'RUNNING' END AS status, o_orderdate AS created_at, CAST(o_custkey % 50 AS BIGINT) AS user_id FROM orders)""",
    "parts": """parts AS (SELECT CAST(l_orderkey AS BIGINT) AS session_id, CAST(l_linenumber - 1 AS BIGINT) AS part_number, CAST(l_quantity AS BIGINT) AS size_bytes,
  (l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS written FROM lineitem)""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTES[n] for n in names) + " "
