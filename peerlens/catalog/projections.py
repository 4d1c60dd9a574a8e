"""Projections, filters, null handling, set unions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import query, r6, sql_hash, t
from peerlens.catalog.io import TITLE_ABSTRACT_SQL, title_abstract
from peerlens.functions import arrays as A
from peerlens.functions import text as X
from peerlens.functions.hashing import portable_hash
from peerlens.operators import rows as W
from peerlens.sources import sinks as S

WORDS_SQL = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def words_sql(c: str) -> str:
    return WORDS_SQL.format(c=c)


def shorten_sql(c: str, n: int) -> str:
    w, h = words_sql(c), n // 2
    return (
        f"CASE WHEN len({w}) > {n} THEN array_to_string(({w})[1:{h}], ' ') || '...' || "
        f"array_to_string(({w})[-{h}:], ' ') ELSE {c} END"
    )


def remove_links_sql(c: str) -> str:
    for p in X.LINK_PATTERNS:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


@query("prj_select_rename", "SELECT doc_id AS pid, lang AS language, n_chars AS size FROM documents")
def prj_select_rename(spark, sf):
    return t(spark, sf, "documents").drop("source").selectExpr("doc_id AS pid", "lang AS language", "n_chars AS size")


@query(
    "prj_row_id",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders",
)
def prj_row_id(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return W.row_id(o, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "row_id")


@query(
    "prj_prefix_concat",
    f"WITH {TITLE_ABSTRACT_SQL} SELECT doc_id, '<title> ' || title || ' <abstract> ' || abstract AS title_abstract FROM docs",
)
def prj_prefix_concat(spark, sf):
    d = title_abstract(t(spark, sf, "documents"))
    text = F.concat(X.tagged("title", F.coalesce("title", F.lit(""))), F.lit(" "), X.tagged("abstract", F.coalesce("abstract", F.lit(""))))
    return d.select("doc_id", text.alias("title_abstract"))


def _dot(c):
    return f"CASE WHEN length({c}) > 0 THEN regexp_replace({c}, '\\.+$', '') || '.' ELSE '' END"


@query(
    "prj_concat_fields",
    f"""WITH {TITLE_ABSTRACT_SQL},
        x AS (SELECT doc_id, {_dot('title')} || {_dot('abstract')} || {_dot('lang')} || {_dot('source')} AS a,
                     {_dot("abstract")} AS b FROM docs)
        SELECT doc_id, a AS all_fields, CASE WHEN b = '' THEN 'No information.' ELSE b END AS abstract_only FROM x""",
)
def prj_concat_fields(spark, sf):
    d = title_abstract(t(spark, sf, "documents"))
    return d.select(
        "doc_id",
        X.join_sentences(["title", "abstract", "lang", "source"], "NULL").alias("all_fields"),
        X.join_sentences(["abstract"], "No information.").alias("abstract_only"),
    )


def _prompt_sql(task, q):
    task = task.replace("'", "''")
    head = f"### Instruction\n{task}\n\n### Constraints\nAt most 150 words.\nNo URLs or links.\n\n### Technical Question\n"
    return f"'{head}' || {q} || '\n\n### Output\n'"


_QB = shorten_sql(f"(item_id || '[SEP]' || replace({remove_links_sql('text')}, chr(10), ''))", 64)


@query(
    "prj_prompt",
    f"""SELECT item_id, {_prompt_sql(X.ANSWER_TASK, _QB)} AS answer_prompt,
               {_prompt_sql(X.SUMMARY_TASK, _QB)} AS summary_prompt FROM benchmark""",
)
def prj_prompt(spark, sf):
    b = t(spark, sf, "benchmark")
    body = X.remove_newlines(X.remove_links("text"))
    qb = X.shorten(X.pair_text(F.col("item_id").cast("string"), body), 64)
    return b.select(
        "item_id",
        X.prompt(X.ANSWER_TASK, qb).alias("answer_prompt"),
        X.prompt(X.SUMMARY_TASK, qb).alias("summary_prompt"),
    )


@query(
    "flt_predicate",
    "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic <> 1",
)
def flt_predicate(spark, sf):
    return t(spark, sf, "labels").where((F.col("quality") == 1) & (F.col("toxic") != 1))


@query(
    "flt_dropna",
    """SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.quality IS NOT NULL""",
)
def flt_dropna(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return d.na.drop(subset=["quality"]).select("doc_id", "quality", "toxic")


@query(
    "prj_fillna_const",
    """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def prj_fillna_const(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return d.withColumn("toxic", F.col("toxic").cast("string")).na.fill({"quality": 0, "toxic": ""})


@query(
    "prj_fillna_group_mean",
    f"""WITH y AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE year(o_orderdate) END AS year FROM orders)
        SELECT o_custkey, o_orderkey, {r6("coalesce(year, avg(year) OVER (PARTITION BY o_custkey))")} AS year FROM y""",
)
def prj_fillna_group_mean(spark, sf):
    o = t(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") != "2-HIGH", F.year("o_orderdate")).cast("double").alias("year")
    )
    return W.fill_group_mean(o, "o_custkey", "o_orderkey", "year").withColumn("year", A.r6("year"))


@query(
    "prj_fillna_train_mean",
    f"""WITH x AS (SELECT d.doc_id, l.quality, l.toxic, {sql_hash(42, 'd.source')} % 10 < 7 AS train
                   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT doc_id, {r6("coalesce(quality, (SELECT avg(quality) FROM x WHERE train))")} AS quality,
               {r6("coalesce(toxic, (SELECT avg(toxic) FROM x WHERE train))")} AS toxic FROM x""",
)
def prj_fillna_train_mean(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id", "left")
    train = d.where(portable_hash(42, "source") % 10 < 7)
    out = W.fill_train_mean(d, train, ["quality", "toxic"])
    return out.select("doc_id", A.r6("quality_filled").alias("quality"), A.r6("toxic_filled").alias("toxic"))


@query(
    "prj_cast_clean_year",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
)
def prj_cast_clean_year(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", "0").otherwise(F.year("o_orderdate").cast("string"))
    return t(spark, sf, "orders").select("o_orderkey", X.clean_year(raw).alias("year"))


@query(
    "dedup_keep_first",
    """SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_quantity FROM
         (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def dedup_keep_first(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity")
    return W.keep_first(li, ["l_orderkey", "l_suppkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")])


_NOISE = {
    "n_chars": "n_chars",
    "quality": "quality",
    "toxic": "toxic",
    "constant": "0 * n_chars",
    "rare": "CASE WHEN n_chars > 8000 THEN n_chars END",
    "nothing": "CASE WHEN n_chars < 0 THEN n_chars END",
}


@query(
    "prj_noise_columns",
    "WITH x AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _NOISE.items())
    + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) > 0 AS INTEGER) AS some,
               CAST(count(DISTINCT {c}) > 1 AS INTEGER) AS varies, {r6(f"1 - count({c}) * 1.0 / count(*)")} AS null_ratio,
               CAST(count(DISTINCT {c}) <= 1 OR 1 - count({c}) * 1.0 / count(*) > 0.9 AS INTEGER) AS noise FROM x"""
        for c in _NOISE
    ),
)
def prj_noise_columns(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    x = d.select(*[F.expr(e).alias(c) for c, e in _NOISE.items()])
    return W.noise_report(x, list(_NOISE)).withColumn("null_ratio", A.r6("null_ratio"))


# ---- unions and reshaping ------------------------------------------------------------------------

_TURNS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations),
conv AS (SELECT conv_id,
                max(CASE WHEN role = 'user' AND nth = 1 THEN text END) AS question,
                string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role NOT IN ('user', 'assistant') OR role = 'user' AND nth > 1) AS body,
                coalesce(max(CASE WHEN role = 'assistant' AND nth = 1 THEN text END), '') AS answer,
                coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND nth > 1), '') AS summary
         FROM ranked GROUP BY conv_id)"""
_T = "'<title> ' || title || ' <abstract> ' || abstract"
_Q, _B = "'<question> ' || question", f"'<body> ' || {remove_links_sql('body')}"
_A, _S = "'<llm answer> ' || answer", "'<llm summarize> ' || summary"
_VIEWS_SQL = {
    "question": _Q,
    "question_body": shorten_sql(f"({_Q} || ' ' || {_B})", 64),
    "question_paper": f"{_Q} || ' ' || {shorten_sql('(' + _T + ')', 128)}",
    "question_answer": f"{_Q} || ' ' || {_A}",
    "question_summary": f"{_Q} || ' ' || {_S}",
    "answer": _A,
    "summary": _S,
    "question_answer_summary": f"{_Q} || ' ' || {_A} || ' ' || {_S}",
}


def question_rows(spark, sf):
    """Questions, bodies and generated texts from the turns of each conversation.

    The first user turn asks, the first assistant turn answers; all other assistant turns are the summary, all other
    turns the body, in order.
    """
    turns = t(spark, sf, "conversations").where(F.col("text").isNotNull())
    firsts = {r: F.min(F.when(F.col("role") == r, F.col("turn"))).alias(r) for r in ("user", "assistant")}
    said = turns.groupBy("conv_id").agg(*firsts.values(), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    pick = lambda keep: F.transform(F.filter("said", keep), lambda x: x["text"])
    joined = lambda keep: F.when(F.size(pick(keep)) > 0, F.array_join(pick(keep), "\n"))
    first = lambda role: joined(lambda x: (x["role"] == role) & (x["turn"] == F.col(role)))
    later = lambda role: (lambda x: (x["role"] == role) & (x["turn"] > F.col(role)))
    return said.select(
        "conv_id",
        first("user").alias("question"),
        joined(lambda x: ~x["role"].isin("user", "assistant") | later("user")(x)).alias("body"),
        F.coalesce(first("assistant"), F.lit("")).alias("answer"),
        F.coalesce(joined(later("assistant")), F.lit("")).alias("summary"),
    )


@query(
    "set_union_views",
    f"WITH {TITLE_ABSTRACT_SQL}, {_TURNS}, rows_ AS (SELECT doc_id AS pid, docs.*, conv.* FROM conv JOIN docs ON conv.conv_id = docs.doc_id) "
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT pid, '{v}' AS view, {e} AS text FROM rows_" for v, e in _VIEWS_SQL.items())
    + f" UNION ALL SELECT doc_id AS pid, 'paper' AS view, {_T} AS text FROM docs) WHERE text IS NOT NULL",
)
def set_union_views(spark, sf):
    papers = title_abstract(t(spark, sf, "documents")).select(F.col("doc_id").alias("pid"), "title", "abstract")
    rows = question_rows(spark, sf).join(papers, F.col("conv_id") == F.col("pid"))
    return W.passage_views(rows, papers, max_words=64, passage_words=128)


@query(
    "set_union_labels",
    """SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders
       WHERE o_orderstatus IN ('F', 'O')""",
)
def set_union_labels(spark, sf):
    key, none = F.array("o_orderkey"), F.array().cast("array<bigint>")
    lists = t(spark, sf, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderstatus") == "F", key).otherwise(none).alias("normal_data"),
        F.when(F.col("o_orderstatus") == "O", key).otherwise(none).alias("outliers"),
    )
    return W.explode_labels(lists, "o_custkey", "normal_data", "outliers", "o_orderkey")


@query(
    "rsh_explode",
    "SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM documents",
)
def rsh_explode(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(
    "rsh_explode_zip",
    """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(CAST(embedding AS DOUBLE[])) AS value,
              unnest(list_reverse(CAST(embedding AS DOUBLE[]))) AS mirrored FROM embeddings""",
)
def rsh_explode_zip(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", A.doubles("embedding").alias("a"))
    z = e.select("vec_id", F.posexplode(F.arrays_zip(F.col("a"), F.reverse("a").alias("b"))).alias("pos", "z"))
    return z.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("z.a").alias("value"), F.col("z.b").alias("mirrored"))


@query(
    "rsh_implode_map",
    """SELECT o_custkey, CAST(0 AS BIGINT) AS part, string_agg(o_orderkey || '=' || o_totalprice, ';' ORDER BY o_orderkey) AS entries
       FROM orders GROUP BY o_custkey""",
)
def rsh_implode_map(spark, sf):
    m = S.implode_map(t(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    flat = F.transform(F.sort_array(F.map_entries("map")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return m.select("o_custkey", "part", F.array_join(flat, ";").alias("entries"))
