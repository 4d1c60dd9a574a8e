"""Quality rules: word, symbol, line and repetition counts of each text, and lines that many documents of a host share.

DataFrame functions only. The counts of a text are computed inside its row, so no word is ever shuffled. Lines
leave the row as (host, 64-bit hash) pairs that are counted with a map-side sum; only the lines above the limit
are matched back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import SPACES, aside, table

_SIGN = r"[^\x20\x09-\x0D]"

#: A line is boilerplate if more documents of its host than this have it, however large the host is.
MIN_DOCS = 10
#: A document is depleted if boilerplate lines hold more than this share of its word characters.
MAX_LOSS = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of three words that occur at least twice in the text.

    Texts whose windows are all different, most of them, only pay for a hash set. Otherwise the windows are sorted
    by hash with their places, equal neighbours are kept, and the covered words are counted from the sorted places.
    """
    n = F.size(words) - (window - 1)
    starts = F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))
    digest = lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, window)])
    hashes = F.transform(starts, digest)
    order = F.sort_array(F.transform(starts, lambda x, i: F.struct(digest(x, i).alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    same = lambda x: x["own"].isNotNull() & (F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)))
    near = lambda o: F.arrays_zip(o.alias("own"), F.concat(none, o).alias("before"), F.slice(o, F.lit(2), F.size(o)).alias("after"))
    places = _once(order, lambda o: F.sort_array(F.transform(F.filter(near(o), same), lambda x: x["own"]["i"])))
    steps = lambda p: F.arrays_zip(p.alias("at"), F.slice(p, F.lit(2), F.size(p)).alias("next"))
    covered = _once(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda total, x: total + F.coalesce(F.least(F.lit(window), x["next"] - x["at"]), F.lit(window))))
    return F.when(F.size(F.array_distinct(hashes)) >= n, F.lit(0)).otherwise(covered).cast("long")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(F.regexp_replace(F.lower(line), SPACES, " ")))


def _counted(docs: DataFrame, id_col: str, text_col: str, host_col: str, clean: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"), F.col(text_col).cast("string").alias("whole"))
    split = read.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(_SIGN)).alias("lines"), "whole")
    return split.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(_line_hash(x).alias("h"), F.length(F.regexp_replace(x, SPACES, "")).alias("c"))).alias("lines"),
        *["whole"] * clean,
    )


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, max_loss: float = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", clean: bool = False) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``n_line_chars`` (word characters in boilerplate lines), ``kept``.

    With ``clean`` also ``clean_text``: the text without its boilerplate lines, all other lines as they are, null for a
    null text. The texts are then written once and shuffled by row.

    A null text counts as empty: it fails for having no words. A null host is the host ''. Each row counts as one
    document, so repeated rows count once each and all get the same result. Ties at a limit stay: a line must be in
    more documents than the limit, and more than the share of characters must be lost. Other columns are not read.
    """
    # Row numbers are fixed by writing them.
    rows = aside(_counted(docs, id_col, text_col, host_col, clean), "quality-rows")
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    common = aside(lines.select("host", "h"), "quality-lines")
    hits = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.c").join(common, ["host", "h"])
    lost = hits.groupBy("row").agg(F.sum("c").alias("lost"), *[F.collect_set("h").alias("gone")] * clean)
    out = rows.drop("lines").join(lost, "row", "left").withColumn("n_line_chars", F.coalesce(F.col("lost"), F.lit(0)).cast("long"))
    # A line without a sign is none of the counted ones and stays.
    left = F.filter(F.split(F.col("whole"), "\n"), lambda x: ~(x.rlike(_SIGN) & F.array_contains(F.col("gone"), _line_hash(x))))
    text = F.when(F.col("lost").isNull(), F.col("whole")).otherwise(F.array_join(left, "\n")).alias("clean_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("n_line_chars") <= F.col("word_chars") * max_loss)).alias("kept"), "n_line_chars", *[text] * clean)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, host, line, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
com AS (SELECT host, k FROM ln GROUP BY host, k HAVING count(DISTINCT r) > {MIN_DOCS}),
lost AS (SELECT r, sum(c) AS c FROM ln JOIN com USING (host, k) GROUP BY r),
m AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.c, 0)::BIGINT AS n_line_chars
 FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_line_chars <= word_chars * {MAX_LOSS}::DOUBLE AS kept FROM b
"""
}
