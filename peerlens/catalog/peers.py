"""Set scores, TF-IDF, graphs and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import query, r6, sql_hash, t
from peerlens.catalog.io import title_abstract
from peerlens.catalog.texts import NAMES_SQL, author_rows, clean_sql, filter_sql
from peerlens.functions import arrays as A
from peerlens.functions import text as X
from peerlens.functions.hashing import portable_hash
from peerlens.operators import cbow as CB
from peerlens.operators import factor as FA
from peerlens.operators import graph as GR
from peerlens.operators import sets as S
from peerlens.operators import tfidf as TF
from peerlens.operators import vectors as V
from peerlens.operators import wordvec as WV
from peerlens.plans import graph as GP
from peerlens.plans import membership as MB
from peerlens.plans import papers as PP
from peerlens.runtime import dealt, pin, spread


def order_sets(spark, sf):
    """Distinct suppliers of each order, by customer; an order is one record, so its set is bounded."""
    li = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.col("l_suppkey").cast("string")).alias("elements")
    )
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey").join(li, "o_orderkey", "left")
    return o.withColumn("elements", F.coalesce("elements", F.array().cast("array<string>")))


@query(
    "set_pair_scores",
    f"""WITH o AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
        e AS (SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        z AS (SELECT o_orderkey, count(*) AS size FROM e GROUP BY o_orderkey),
        p AS (SELECT a.o_orderkey, b.o_orderkey AS other, count(*) AS shared FROM e a JOIN e b
                ON a.o_custkey = b.o_custkey AND a.l_suppkey = b.l_suppkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1, 2),
        s AS (SELECT p.o_orderkey, count(*) AS co, sum(shared * 1.0::DOUBLE / (za.size + zb.size - shared)) AS jac FROM p
                JOIN z za ON p.o_orderkey = za.o_orderkey JOIN z zb ON p.other = zb.o_orderkey GROUP BY p.o_orderkey)
        SELECT o.o_custkey, o.o_orderkey, {r6('coalesce(co, 0) * 1.0::DOUBLE / n')} AS supp_co, {r6('coalesce(jac, 0) / n')} AS supp_jac
        FROM o LEFT JOIN s ON o.o_orderkey = s.o_orderkey""",
)
def set_pair_scores(spark, sf):
    s = S.pair_scores(order_sets(spark, sf), "o_custkey", "o_orderkey", "elements", "supp")
    return s.withColumns({c: A.r6(c) for c in ("supp_co", "supp_jac")})


# ---- TF-IDF --------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in TF.stop_terms()) + "]"


def tfidf_sql(source: str = "SELECT source AS g, doc_id AS d, text AS x FROM documents") -> str:
    return rf"""src AS ({source}),
tok AS (SELECT g, d, list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM src),
gram AS (SELECT g, d, unnest(w) AS term FROM tok UNION ALL
         SELECT g, d, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok),
tf AS (SELECT g, d, term, count(*) AS tf FROM gram GROUP BY g, d, term),
df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY g, term),
n AS (SELECT g, count(*) AS n FROM src GROUP BY g),
raw AS (SELECT tf.g, tf.d, tf.term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.g = df.g AND tf.term = df.term JOIN n ON tf.g = n.g),
wt AS (SELECT g, d, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, d)) AS w FROM raw)"""


@query("tfi_group_tfidf", f"WITH {tfidf_sql()} SELECT g AS source, d AS doc_id, term, {r6('w')} AS weight FROM wt")
def tfi_group_tfidf(spark, sf):
    w = TF.tfidf(t(spark, sf, "documents"), "source", "doc_id", "text")
    return w.withColumn("weight", A.r6("weight"))


@query(
    "tfi_cosine",
    f"""WITH {tfidf_sql()}, p AS (SELECT a.g, a.d, b.d AS o, sum(a.w * b.w) AS c FROM wt a JOIN wt b ON a.g = b.g AND a.term = b.term AND a.d <> b.d GROUP BY 1, 2, 3),
        k AS (SELECT g, count(DISTINCT d) AS k FROM wt GROUP BY g),
        s AS (SELECT g, d, sum(c) AS s, max(c) AS hi, count(*) AS m FROM p GROUP BY g, d)
        SELECT x.g AS source, x.d AS doc_id, {r6('coalesce(s, 0) / k')} AS cos_mean, {r6('coalesce(hi, 0)')} AS cos_max
        FROM (SELECT DISTINCT g, d FROM wt) x JOIN k ON x.g = k.g LEFT JOIN s ON x.g = s.g AND x.d = s.d""",
)
def tfi_cosine(spark, sf):
    w = TF.tfidf(t(spark, sf, "documents"), "source", "doc_id", "text")
    c = TF.tfidf_cosine(w, "source", "doc_id")
    return c.select("source", "doc_id", A.r6("cos_mean").alias("cos_mean"), A.r6("cos_max").alias("cos_max"))


@query("tfi_svd")
def tfi_svd(spark, sf):
    w = TF.tfidf(t(spark, sf, "documents"), "source", "doc_id", "text")
    s = TF.tfidf_svd(w, "source", "doc_id")
    return s.select("source", "doc_id", F.size("svd").alias("directions"), A.r6(A.norm("svd")).alias("length"))


@query(
    "tfi_svd_cosine",
    f"""WITH {tfidf_sql()}, s AS (SELECT g, term, sum(w) AS s FROM wt GROUP BY g, term), k AS (SELECT g, count(DISTINCT d) AS k FROM wt GROUP BY g)
        SELECT wt.g AS source, d AS doc_id, {r6('(sum(w * s) - 1) / any_value(k)')} AS cos_mean
        FROM wt JOIN s ON wt.g = s.g AND wt.term = s.term JOIN k ON wt.g = k.g GROUP BY wt.g, d""",
)
def tfi_svd_cosine(spark, sf):
    """With as many directions as documents nothing is lost: cosines equal those of the TF-IDF rows."""
    w = TF.tfidf(t(spark, sf, "documents"), "source", "doc_id", "text")
    s = TF.tfidf_svd(w, "source", "doc_id", k=FA.ROWS)
    return V.cos_mean_linear(s, "source", "doc_id", "svd", "cos_mean").withColumn("cos_mean", A.r6("cos_mean"))


_FIELDS = {"title": "split_part(text, chr(10), 1)", "lang": "lang || ' ' || source", "all": "text"}


@query(
    "tfi_fields",
    "WITH " + tfidf_sql(" UNION ALL ".join(f"SELECT source || '|{f}' AS g, doc_id AS d, {e} AS x FROM documents" for f, e in _FIELDS.items()))
    + f""", s AS (SELECT g, term, sum(w) AS s FROM wt GROUP BY g, term), l AS (SELECT g, sqrt(sum(s * s)) AS l FROM s GROUP BY g),
        k AS (SELECT g, count(DISTINCT d) AS k FROM wt GROUP BY g),
        dt AS (SELECT wt.g, d, sum(w * s) AS dot FROM wt JOIN s ON wt.g = s.g AND wt.term = s.term GROUP BY wt.g, d)
        SELECT dt.g AS field, dt.d AS doc_id, {r6('(dot - 1) / k')} AS cos_mean, {r6('dot / l')} AS cos_author
        FROM dt JOIN l ON dt.g = l.g JOIN k ON dt.g = k.g""",
)
def tfi_fields(spark, sf):
    d = t(spark, sf, "documents")
    parts = {"title": F.substring_index("text", "\n", 1), "lang": F.concat_ws(" ", "lang", "source"), "all": F.col("text")}
    each = F.explode(F.array(*[F.struct(F.concat(F.col("source"), F.lit(f"|{f}")).alias("field"), c.alias("x")) for f, c in parts.items()]))
    long = d.select("doc_id", each.alias("_e")).select("doc_id", "_e.field", "_e.x")
    c = TF.cosine_mean(TF.tfidf(long, "field", "doc_id", "x"), "field", "doc_id", large=TF.crowded(long, "field"))
    return c.withColumns({x: A.r6(x) for x in ("cos_mean", "cos_author")})


# ---- graph ---------------------------------------------------------------------------------------

EDGES_SQL = f"""{NAMES_SQL},
au AS (SELECT DISTINCT o_custkey, o_orderkey, unnest(string_split(name, ',')) AS key, own FROM names),
author_edges AS (SELECT DISTINCT o_custkey, o_orderkey, key FROM au WHERE key <> CAST(own AS VARCHAR)),
org_edges AS (SELECT DISTINCT o_custkey, o_orderkey, replace(org, ',NULL', '') AS key FROM names WHERE list_contains(string_split(name, ','), CAST(own AS VARCHAR))),
venue_edges AS (SELECT o_custkey, o_orderkey, unnest(CASE WHEN o_orderpriority LIKE '4%' THEN ['null'] ELSE list_distinct(string_split({clean_sql('o_orderpriority')}, ' ')) END) AS key FROM orders)"""


def graph_edges(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    o = dealt(o, o.count(), "o_orderkey")
    words = F.when(F.col("o_orderpriority").startswith("4"), F.array().cast("array<string>")).otherwise(
        F.array_distinct(X.spaced(X.clean("o_orderpriority")))
    )
    p = author_rows(spark, sf)
    return {
        "author": GR.author_edges(p, "o_custkey", "o_orderkey", "authors", "own"),
        "org": GR.org_edges(p, "o_custkey", "o_orderkey", "authors", "own"),
        "venue": GR.venue_edges(o.withColumn("venue", words), "o_custkey", "o_orderkey", "venue"),
    }


@query(
    "gra_edges",
    f"WITH {EDGES_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, o_custkey, o_orderkey, key FROM {k}_edges" for k in ("author", "org", "venue")),
)
def gra_edges(spark, sf):
    parts = [e.select(F.lit(k).alias("kind"), "o_custkey", "o_orderkey", "key") for k, e in graph_edges(spark, sf).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "gra_adjacency",
    f"""WITH {EDGES_SQL} SELECT o_custkey, key, CAST(0 AS BIGINT) AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS papers
        FROM author_edges GROUP BY o_custkey, key""",
)
def gra_adjacency(spark, sf):
    a = GR.adjacency(graph_edges(spark, sf)["author"], ["o_custkey", "key"], "o_orderkey", name="papers")
    return a.withColumn("papers", F.array_join(F.transform("papers", lambda x: x.cast("string")), ","))


_WALKS, _STEPS = 5, 20  # fixed values


def _walk_sql() -> str:
    parts = [EDGES_SQL, f"w0 AS MATERIALIZED (SELECT o_custkey AS g, o_orderkey AS p, o_orderkey AS loc, unnest(range({_WALKS})) AS walk, CAST([] AS VARCHAR[]) AS path FROM orders)"]
    for k in ("author", "org"):
        parts.append(
            f"""{k}_h AS (SELECT o_custkey AS g, o_orderkey AS loc, key, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY key) - 1 AS kidx,
               count(*) OVER (PARTITION BY o_custkey, o_orderkey) AS kdeg, row_number() OVER (PARTITION BY o_custkey, key ORDER BY o_orderkey) - 1 AS pidx,
               count(*) OVER (PARTITION BY o_custkey, key) AS pdeg FROM {k}_edges)"""
        )
    i = 0
    for step in range(_STEPS):
        for kind, k in enumerate(("author", "org")):
            draw = f"({sql_hash(f'0|{step}|{kind}|p', 'w.p', 'w.walk')} % nullif(h.pdeg - 1, 0))"
            parts.append(
                f"""w{i + 1} AS MATERIALIZED (SELECT w.g, w.p, w.walk, coalesce(n.loc, w.loc) AS loc,
                      CASE WHEN n.loc IS NULL THEN w.path ELSE list_append(w.path, CAST(n.loc AS VARCHAR)) END AS path
                    FROM w{i} w LEFT JOIN (SELECT DISTINCT g, loc, kdeg FROM {k}_h) c ON c.g = w.g AND c.loc = w.loc
                    LEFT JOIN {k}_h h ON h.g = w.g AND h.loc = w.loc AND h.kidx = {sql_hash(f'0|{step}|{kind}|k', 'w.p', 'w.walk')} % c.kdeg
                    LEFT JOIN {k}_h n ON n.g = w.g AND n.key = h.key AND h.pdeg > 1 AND n.pidx = CASE WHEN {draw} < h.pidx THEN {draw} ELSE {draw} + 1 END)"""
            )
            i += 1
    parts.append(f"moved AS (SELECT DISTINCT g FROM w{i} WHERE len(path) > 0)")
    return f"""WITH {", ".join(parts)}
      SELECT g AS o_custkey, p AS o_orderkey, CAST(walk AS INTEGER) AS walk, array_to_string(path, '>') AS path FROM w{i} WHERE g IN (SELECT g FROM moved)
      UNION ALL SELECT g, p, 0, CAST(p AS VARCHAR) FROM w{i} WHERE walk = 0 AND g NOT IN (SELECT g FROM moved)"""


def walks(spark, sf, n, steps, seed=0):
    e = graph_edges(spark, sf)
    hops = [GR.hop_table(e[k], "o_custkey", "o_orderkey") for k in ("author", "org")]
    papers = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return GR.metapath_walks(papers, hops, "o_custkey", "o_orderkey", walks=n, steps=steps, seed=seed)


@query("gra_metapath_walk", _walk_sql())
def gra_metapath_walk(spark, sf):
    w = walks(spark, sf, _WALKS, _STEPS)
    return w.select("o_custkey", "o_orderkey", "walk", F.array_join("path", ">").alias("path"))


def _hops(spark, sf):
    e = graph_edges(spark, sf)
    return [GR.hop_table(e[k], "o_custkey", "o_orderkey") for k in ("author", "org")]


@query("gra_walk_embed")
def gra_walk_embed(spark, sf):
    papers = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    v = GP.walk_vectors(papers, _hops(spark, sf), "o_custkey", "o_orderkey")
    return v.select("o_custkey", "o_orderkey", A.r6(A.norm("vector")).alias("length"))


@query("gra_features")
def gra_features(spark, sf):
    papers = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    text = WV.word_mean(order_sets(spark, sf), "o_orderkey", "elements", hash_elements(spark, sf), size=4)
    block = GP.block_features(pin(text.select("o_custkey", "o_orderkey", "vector"), "text"), "o_custkey", "o_orderkey", "graph_w2v")
    return GP.graph_features(papers, _hops(spark, sf), "o_custkey", "o_orderkey", text_block=block)


def hash_elements(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("word")).distinct()
    return s.select("word", F.array(*[(portable_hash(i, "word") % 1000) / 500.0 - 1 for i in range(4)]).alias("vector"))


# ---- word vectors --------------------------------------------------------------------------------


def doc_tokens(spark, sf):
    return spread(t(spark, sf, "documents").select("source", "doc_id", "text")).select("source", "doc_id", X.tokens(X.clean("text"), X.STOP_WORDS).alias("tokens"))


def raw_papers(spark, sf):
    """Documents as raw paper records."""
    d = title_abstract(t(spark, sf, "documents"))
    author = lambda n, o: F.struct(n.alias("name"), o.alias("org"))
    first, second = F.substring_index("title", " ", 2), F.substring_index("title", " ", -2)
    return spread(d).select(
        F.col("doc_id").cast("string").alias("id"), "title", "abstract",
        F.array("lang", F.concat_ws(" ", "source", "lang")).alias("keywords"),
        F.array(author(first, F.col("title")), author(second, F.col("source"))).alias("authors"),
        F.col("source").alias("venue"), F.col("n_chars").cast("string").alias("year"), F.col("source").alias("group"),
    )


# Fixed values of the two corpora; vectors of 128 numbers, 5 negatives and 30 epochs are the operator's defaults.
PAPER_WORDS, ORG_WORDS = {"min_count": 2, "window": 10}, {"min_count": 5, "window": 5}
SIZE = 128


def token_papers(spark, sf):
    """Documents as paper records of tokens, with their group; cleaned and filtered like ``clean_paper_records``, but not stemmed."""
    raw = raw_papers(spark, sf)
    words = lambda c: X.tokens(X.clean(c), X.STOP_WORDS)
    org = lambda a: F.array_join(F.sort_array(F.array_distinct(words(a["org"]))), ",")
    authors = F.transform("authors", lambda a: F.struct(a["name"].alias("name"), F.when(org(a) == "", "NULL").otherwise(org(a)).alias("org")))
    return pin(
        raw.select(
            "id", F.col("group").alias("source"), authors.alias("authors"), X.clean_year("year").alias("year"),
            words("title").alias("title"), words("abstract").alias("abstract"), words("venue").alias("venue"),
            words(F.array_join("keywords", " ")).alias("keywords"),
        ), "papers",
    )


def _paper_words(papers):
    return CB.train(PP.paper_corpus(papers), "tokens", size=SIZE, **PAPER_WORDS)


@query("w2v_train")
def w2v_train(spark, sf):
    return _paper_words(token_papers(spark, sf)).select("word", "n", A.r6(A.norm(A.doubles("vector"))).alias("length"))


@query("w2v_org_train")
def w2v_org_train(spark, sf):
    return CB.train(PP.org_corpus(token_papers(spark, sf)), "tokens", size=SIZE, **ORG_WORDS).select("word", "n", A.r6(A.norm(A.doubles("vector"))).alias("length"))


@query("w2v_synonyms")
def w2v_synonyms(spark, sf):
    table = pin(_paper_words(token_papers(spark, sf)), "words")
    common = table.orderBy(F.desc("n"), "word").first()
    return CB.synonyms(table, common["word"] if common else "", 10).select("word", A.r6("similarity").alias("similarity"))


def word_features(papers, group, key):
    """Word-vector features of all seven fields, the panel for three; organisations have a model of their own."""
    words, orgs = pin(_paper_words(papers), "words"), pin(CB.train(PP.org_corpus(papers), "tokens", size=SIZE, **ORG_WORDS), "org-words")
    year = F.when(F.col("year") > 0, F.array(F.col("year").cast("string"))).otherwise(F.array().cast("array<string>"))
    # Organisations of the authors that are not the group's own; a document's group is no author, so of all.
    listed = F.filter(F.flatten(F.transform("authors", lambda a: F.split(a["org"], ","))), lambda w: w != "NULL")
    fields = pin(
        papers.select(
            group, F.col("id").cast("long").alias(key), *PP.TEXTS, listed.alias("orgs"),
            F.concat("title", "abstract").alias("title_abstract"), F.concat(*PP.TEXTS, year).alias("everything"),
        ), "fields",
    )
    names = {"all": "everything", **{c: c for c in PP.TEXTS}, "orgs": "orgs", "title_abstract": "title_abstract"}
    return MB.word_vector_blocks(fields, group, key, names, words, size=SIZE, tables={"orgs": orgs})


@query("w2v_features")
def w2v_features(spark, sf):
    return word_features(token_papers(spark, sf), "source", "doc_id")


_HASHV = "[" + ", ".join(f"({sql_hash(i, 'word')} % 1000) / 500.0::DOUBLE - 1" for i in range(4)) + "]"
_TOK = filter_sql("string_split(" + clean_sql("text") + ", chr(32))", X.STOP_WORDS)
_WORDS_SQL = f"""tok AS (SELECT source, doc_id, {_TOK} AS w FROM documents), l AS (SELECT source, doc_id, unnest(w) AS word FROM tok),
wc AS (SELECT word, count(*) AS n FROM l GROUP BY word HAVING count(*) >= 3), wv AS (SELECT word, {_HASHV} AS v FROM wc),
k AS (SELECT source, doc_id, unnest(v) AS c, generate_subscripts(v, 1) AS dim FROM l JOIN wv ON l.word = wv.word)"""


def hash_vectors(d):
    """A word-vector table that any engine can rebuild: four hashed components of the words seen three times or more."""
    words = d.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return words.select("word", F.array(*[(portable_hash(i, "word") % 1000) / 500.0 - 1 for i in range(4)]).alias("vector"))


@query(
    "vec_word_mean",
    f"""WITH {_WORDS_SQL}, m AS (SELECT doc_id, dim, avg(c) AS c FROM k GROUP BY doc_id, dim)
        SELECT d.doc_id, """
    + ", ".join(f"{r6(f'coalesce((SELECT c FROM m WHERE m.doc_id = d.doc_id AND dim = {i + 1}), 0)')} AS v{i}" for i in range(4))
    + " FROM documents d",
)
def vec_word_mean(spark, sf):
    d = pin(doc_tokens(spark, sf), "tokens")
    m = WV.word_mean(d, "doc_id", "tokens", hash_vectors(d), size=4)
    return m.select("doc_id", *[A.r6(F.col("vector")[i]).alias(f"v{i}") for i in range(4)])


@query(
    "vec_cos_to_bag",
    f"""WITH {_WORDS_SQL}, m AS (SELECT source, doc_id, list(c ORDER BY dim) AS v FROM (SELECT source, doc_id, dim, avg(c) AS c FROM k GROUP BY source, doc_id, dim) GROUP BY source, doc_id),
        b AS (SELECT source, list(c ORDER BY dim) AS v FROM (SELECT source, dim, avg(c) AS c FROM k GROUP BY source, dim) GROUP BY source)
        SELECT d.source, d.doc_id, {r6('list_cosine_similarity(m.v, b.v)')} AS cos_bag FROM documents d
        LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN b ON d.source = b.source""",
)
def vec_cos_to_bag(spark, sf):
    d = pin(doc_tokens(spark, sf), "tokens")
    c = WV.cos_to_bag(d, "source", "doc_id", "tokens", hash_vectors(d), size=4, name="cos_bag")
    return c.withColumn("cos_bag", A.r6("cos_bag"))
