"""Text cleaning, tokenising, names, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import query, r6, t
from peerlens.catalog.io import TITLE_ABSTRACT_SQL, title_abstract
from peerlens.catalog.projections import remove_links_sql, shorten_sql
from peerlens.functions import arrays as A
from peerlens.functions import language as L
from peerlens.functions import text as X
from peerlens.operators.vocabulary import stem_tokens
from peerlens.runtime import dealt, spread

SP = "\\s"


def clean_sql(c: str) -> str:
    punct = X.PUNCTUATION_CLASS.replace("'", "''")
    x = f"lower(regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g'))"
    x = f"translate({x}, chr(10) || chr(160) || chr(92) || chr(8208), '    ')"
    x = f"regexp_replace({x}, '{punct}', ' ', 'g')"
    x = f"regexp_replace({x}, '{SP}{{2,}}', ' ', 'g')"
    return f"coalesce(regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g'), '')"


def _list_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def filter_sql(tokens: str, stop) -> str:
    kept = f"list_filter({tokens}, lambda w: NOT list_contains({_list_sql(stop)}, w) AND NOT regexp_full_match(w, '[0-9]+'))"
    return f"list_filter(list_transform({kept}, lambda w: regexp_replace(w, '[0-9]+', '0', 'g')), lambda w: length(w) > 1)"


def _pages(spark, sf):
    return spread(t(spark, sf, "pages").select("page_id", "html"))


def _docs(spark, sf):
    return spread(t(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("txt_shorten_head_tail", f"SELECT doc_id, {shorten_sql('text', 50)} AS short FROM documents")
def txt_shorten_head_tail(spark, sf):
    return _docs(spark, sf).select("doc_id", X.shorten("text", 50).alias("short"))


@query(
    "txt_truncate_words",
    "SELECT doc_id, array_to_string(string_split(text, ' ')[1:64], ' ') AS first_words FROM documents",
)
def txt_truncate_words(spark, sf):
    return _docs(spark, sf).select("doc_id", X.first_words("text", 64).alias("first_words"))


@query(
    "txt_pair_sep",
    "SELECT l.doc_id, CAST(l.doc_id AS VARCHAR) || '[SEP]' || d.text AS text FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
)
def txt_pair_sep(spark, sf):
    d = t(spark, sf, "labels").select("doc_id").join(t(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", X.pair_text(F.col("doc_id").cast("string"), "text").alias("text"))


@query("txt_remove_links", f"SELECT page_id, {remove_links_sql('html')} AS text FROM pages")
def txt_remove_links(spark, sf):
    return _pages(spark, sf).select("page_id", X.remove_links("html").alias("text"))


@query(
    "txt_remove_special",
    r"""SELECT page_id, regexp_replace(regexp_replace(html, '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '[\t\n\r\x07\f\x0b\x08]', ' ', 'g') AS text FROM pages""",
)
def txt_remove_special(spark, sf):
    return _pages(spark, sf).select("page_id", X.remove_special("html").alias("text"))


@query("txt_remove_newlines", "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents")
def txt_remove_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", X.remove_newlines("text").alias("text"))


@query("txt_clean", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def txt_clean(spark, sf):
    return _pages(spark, sf).select("page_id", X.clean("html").alias("text"))


@query(
    "txt_tokenize_filter",
    f"SELECT page_id, array_to_string({filter_sql('string_split(' + clean_sql('html') + ', chr(32))', X.STOP_WORDS)}, '|') AS tokens FROM pages",
)
def txt_tokenize_filter(spark, sf):
    return _pages(spark, sf).select("page_id", F.array_join(X.tokens(X.clean("html"), X.STOP_WORDS), "|").alias("tokens"))


@query(
    "txt_tokenize_light",
    f"SELECT page_id, array_to_string(list_transform(string_split({clean_sql('html')}, ' '), lambda w: regexp_replace(w, '[0-9]+', '0', 'g')), '|') AS tokens FROM pages",
)
def txt_tokenize_light(spark, sf):
    return _pages(spark, sf).select("page_id", F.array_join(X.tokens_light(X.clean("html")), "|").alias("tokens"))


@query("txt_vocab_normalize")
def txt_vocab_normalize(spark, sf):
    d = _docs(spark, sf).select("doc_id", X.tokens(X.clean("text"), X.STOP_WORDS).alias("tokens"))
    s = stem_tokens(d, "tokens")
    return s.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query(
    "txt_parse_list_string",
    """SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_item, max(o_orderkey) AS last_item FROM orders GROUP BY o_custkey""",
)
def txt_parse_list_string(spark, sf):
    printed = F.concat(F.lit("['"), F.col("o_custkey").cast("string"), F.lit("',\n'"), F.col("o_orderkey").cast("string"), F.lit("']"))
    parsed = t(spark, sf, "orders").select(X.parse_list(printed).alias("l"))
    item = F.col("l")[1].cast("long")
    return parsed.groupBy(F.col("l")[0].cast("long").alias("o_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item")
    )


_NAME = clean_sql("p_brand || ' ' || p_name || ' ' || p_size")
_N = f"list_filter(string_split({_NAME}, ' '), lambda w: NOT regexp_full_match(w, '[0-9]+'))"


@query(
    "txt_name_canonical",
    f"""WITH x AS (SELECT p_partkey, {_N} AS n, list_filter(string_split({clean_sql('p_name')}, ' '), lambda w: NOT regexp_full_match(w, '[0-9]+')) AS m FROM part)
        SELECT p_partkey,
          CASE WHEN len(n) > 2 THEN least(n[1] || n[2] || n[3], n[3] || n[2] || n[1]) WHEN len(n) = 2 THEN least(n[1] || n[2], n[2] || n[1])
               WHEN len(n) = 1 AND n[1] <> '' THEN n[1] ELSE 'NULL' END AS name,
          CASE WHEN len(m) > 2 THEN least(m[1] || ' ' || m[2] || ' ' || m[3], m[3] || ' ' || m[2] || ' ' || m[1])
               WHEN len(m) = 2 THEN least(m[1] || ' ' || m[2], m[2] || ' ' || m[1])
               WHEN len(m) = 1 AND m[1] <> '' THEN m[1] ELSE 'NULL' END AS spaced FROM x""",
)
def txt_name_canonical(spark, sf):
    long = X.clean(F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string")))
    return t(spark, sf, "part").select(
        "p_partkey", X.canonical_name(long).alias("name"), X.canonical_name(X.clean("p_name"), " ").alias("spaced")
    )


_ORG = filter_sql("string_split(" + clean_sql("text") + ", chr(32))", X.STOP_WORDS + X.ORG_STOP_WORDS)


@query(
    "txt_org_tokens",
    f"""WITH x AS (SELECT conv_id, turn, list_sort(list_distinct({_ORG})) AS l FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN 'NULL' ELSE array_to_string(l, ',') END AS org FROM x""",
)
def txt_org_tokens(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.org_tokens("text", X.STOP_WORDS), ",").alias("org"))


@query(
    "txt_keywords_flatten",
    f"""WITH x AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda s: string_split({clean_sql('s')}, ' '))) AS w FROM documents)
        SELECT doc_id, len(w) AS n, array_to_string(w, '|') AS words FROM x""",
)
def txt_keywords_flatten(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda s: X.spaced(X.clean(s)))
    w = F.flatten(lines)
    return _docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, "|").alias("words"))


_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}⺀-⿟々-〇]+"


@query(
    "txt_script_flag",
    f"SELECT doc_id, CAST(regexp_matches(text, '{_CJK}') AS INTEGER) AS cjk, array_to_string(regexp_extract_all(text, '{_CJK}'), ' ') AS runs FROM documents",
)
def txt_script_flag(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", X.has_cjk("text").cast("int").alias("cjk"), F.array_join(X.cjk_runs("text"), " ").alias("runs")
    )


_VOTES = ", ".join(f"('{w}', '{lang}')" for lang, ws in L.FUNCTION_WORDS.items() for w in ws.split())


@query(
    "txt_language",
    rf"""WITH votes(word, lang) AS (VALUES {_VOTES}),
        w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
        c AS (SELECT doc_id, votes.lang, count(*) AS n FROM w JOIN votes ON w.word = votes.word GROUP BY doc_id, votes.lang),
        b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS rn FROM c)
        SELECT d.doc_id, d.lang, CASE WHEN length(trim(d.text)) = 0 THEN 'Nothing' WHEN regexp_matches(d.text, '[\x{{3040}}-\x{{30FF}}]') THEN 'ja' WHEN regexp_matches(d.text, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}]') THEN 'zh' ELSE coalesce(b.lang, 'Other') END AS language
        FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND b.rn = 1""",
)
def txt_language(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", "lang")
    return L.detect(d, "doc_id", "text").select("doc_id", "lang", "language")


# Orders stand for papers: their suppliers are names, "self" is the supplier given by the customer key.
_SUPP = "(l_suppkey // 2)"
NAMES_SQL = f"""names AS (SELECT o_custkey, o_orderkey, o_custkey % 50 AS own, l_linenumber,
      CAST(l_suppkey // 2 AS VARCHAR) || ',' || CAST(l_partkey % 50 AS VARCHAR) AS name, 'org' || (l_suppkey % 7) || ',NULL' AS org
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def order_names(spark, sf):
    """One row per author of a paper: comma-joined names and organisation words."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    rows = li.count()
    li, o = dealt(li, rows, "l_orderkey"), dealt(o, rows, "o_orderkey")
    s = lambda c: c.cast("string")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "o_custkey",
        "o_orderkey",
        "l_linenumber",
        s(F.col("o_custkey") % 50).alias("own"),
        F.concat_ws(",", s(F.floor(F.col("l_suppkey") / 2)), s(F.col("l_partkey") % 50)).alias("name"),
        F.concat(F.lit("org"), s(F.col("l_suppkey") % 7), F.lit(",NULL")).alias("org"),
    )


@query(
    "txt_group_name_match",
    f"WITH {NAMES_SQL} SELECT o_orderkey, l_linenumber, name, list_contains(string_split(name, ','), CAST(own AS VARCHAR))::INTEGER AS own FROM names",
)
def txt_group_name_match(spark, sf):
    return order_names(spark, sf).select(
        "o_orderkey", "l_linenumber", "name", F.array_contains(F.split("name", ","), F.col("own")).cast("int").alias("own")
    )


@query(
    "arr_other_members",
    f"""WITH {NAMES_SQL} SELECT o_orderkey, l_linenumber, name,
               CASE WHEN list_contains(string_split(name, ','), CAST(own AS VARCHAR)) THEN '' ELSE name END AS names,
               CASE WHEN list_contains(string_split(name, ','), CAST(own AS VARCHAR)) THEN '' ELSE replace(org, ',NULL', '') END AS orgs
        FROM names""",
)
def arr_other_members(spark, sf):
    p = A.other_members(author_rows(spark, sf), "authors", "own")
    return p.select("o_orderkey", "l_linenumber", "name", F.array_join("names", ",").alias("names"), F.array_join("orgs", ",").alias("orgs"))


def author_rows(spark, sf):
    """Papers with an array of authors, one author per row: these tables hold no author lists, and none is collected."""
    return order_names(spark, sf).withColumn("authors", F.array(F.struct("name", "org")))


@query(
    "arr_counts",
    f"""WITH {TITLE_ABSTRACT_SQL}, x AS (SELECT doc_id, {filter_sql('string_split(' + clean_sql('title') + ', chr(32))', X.STOP_WORDS)} AS tt,
             {filter_sql('string_split(' + clean_sql('abstract') + ', chr(32))', X.STOP_WORDS)} AS aa FROM docs)
        SELECT doc_id, len(tt) AS t_num, len(aa) AS a_num, CASE WHEN len(tt) = 0 AND len(aa) = 0 THEN 1 ELSE 0 END AS no_data FROM x""",
)
def arr_counts(spark, sf):
    d = title_abstract(_docs(spark, sf)).select(
        "doc_id",
        X.tokens(X.clean("title"), X.STOP_WORDS).alias("tt"),
        X.tokens(X.clean("abstract"), X.STOP_WORDS).alias("aa"),
    )
    return A.token_counts(d, {"t_num": "tt", "a_num": "aa"}).select("doc_id", "t_num", "a_num", "no_data")


@query(
    "set_jaccard",
    f"""WITH x AS (SELECT doc_id, list_distinct(string_split({clean_sql('title')}, ' ')) AS a, list_distinct(string_split({clean_sql('abstract')}, ' ')) AS b
                   FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents))
        SELECT doc_id, {r6("len(list_intersect(a, b)) * 1.0 / (len(a) + len(b) - len(list_intersect(a, b)))")} AS jaccard FROM x""",
)
def set_jaccard(spark, sf):
    d = _docs(spark, sf).select(
        "doc_id",
        F.array_distinct(X.spaced(X.clean(F.substring_index("text", "\n", 1)))).alias("a"),
        F.array_distinct(X.spaced(X.clean("text"))).alias("b"),
    )
    return d.select("doc_id", A.r6(A.jaccard("a", "b")).alias("jaccard"))


@query(
    "math_sigmoid",
    f"SELECT c_custkey, {r6('1 / (1 + exp(-c_acctbal / 1000))')} AS p FROM customer",
)
def math_sigmoid(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", A.r6(A.sigmoid(F.col("c_acctbal") / 1000)).alias("p"))
