"""Sources and sinks: the given tables are written in each format and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import query, t
from peerlens.runtime import scratch_path
from peerlens.sources import readers as R
from peerlens.sources import sinks as S


def title_abstract(docs):
    """First line of a document as title, everything after it as abstract."""
    cut = F.locate("\n", F.col("text"))
    return docs.withColumns(
        {
            "title": F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")),
            "abstract": F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise(F.lit("")),
        }
    )


TITLE_ABSTRACT_SQL = """
docs AS (
  SELECT *, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract
  FROM documents)"""


@query(
    "src_jsonl",
    """SELECT conv_id, turn, text AS question, role AS body,
              CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) END AS pids
       FROM conversations""",
)
def src_jsonl(spark, sf):
    c = t(spark, sf, "conversations")
    ids = F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    path = scratch_path(spark, "jsonl")
    S.write_jsonl(
        c.select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("body"),
                 F.when(F.col("role") == "user", ids).alias("pids")), path)
    back = R.read_jsonl(spark, path, "conv_id long, turn long, " + R.QUESTIONS)
    return back.select("conv_id", "turn", "question", "body", F.array_join("pids", ",").alias("pids"))


@query(
    "src_json_map",
    f"WITH {TITLE_ABSTRACT_SQL} SELECT CAST(doc_id AS VARCHAR) AS pid, title, abstract FROM docs",
)
def src_json_map(spark, sf):
    d = title_abstract(t(spark, sf, "documents"))
    path = scratch_path(spark, "jsonmap")
    d.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.struct("title", "abstract")))).write.text(path)
    return R.read_json_map(spark, path)


@query("src_csv", "SELECT conv_id, turn, role, text FROM conversations")
def src_csv(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv(t(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return R.read_csv(spark, path, "conv_id long, turn long, role string, text string")


@query("src_parquet", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000")
def src_parquet(spark, sf):
    return R.read_parquet(spark, f"{sf}/documents.parquet", "doc_id", "lang", "n_chars").where("n_chars > 1000")


@query(
    "sink_parquet",
    """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_doc FROM documents GROUP BY lang""",
)
def sink_parquet(spark, sf):
    path = scratch_path(spark, "features")
    S.write_parquet(t(spark, sf, "documents").select("doc_id", "n_chars", "lang"), path, "lang")
    back = spark.read.schema("doc_id long, n_chars long, lang string").parquet(path)
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc")
    )


@query("sink_csv", "SELECT item_id, text FROM benchmark")
def sink_csv(spark, sf):
    path = scratch_path(spark, "pred")
    S.write_csv(t(spark, sf, "benchmark"), path)
    return R.read_csv(spark, path, "item_id long, text string")


@query(
    "sink_ranked_text",
    """WITH r AS (SELECT o_custkey, o_orderkey,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
       SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS line FROM r WHERE rn <= 20 GROUP BY o_custkey""",
)
def sink_ranked_text(spark, sf):
    path = scratch_path(spark, "ranked")
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    S.write_ranked_text(t(spark, sf, "orders"), path, "o_custkey", "o_orderkey", order)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "sink_group_json",
    """SELECT '{"' || o_custkey || '":{' ||
              string_agg('"' || o_orderkey || '":' || CAST(o_totalprice AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))
              || '}}' AS line
       FROM orders GROUP BY o_custkey""",
)
def sink_group_json(spark, sf):
    path = scratch_path(spark, "groupjson")
    S.write_group_json(t(spark, sf, "orders"), path, "o_custkey", "o_orderkey", "o_totalprice")
    return spark.read.text(path).select(F.col("value").alias("line"))
