"""Row-level semantics on top of plain DataFrame calls: first-row dedup, fills, labels, unions, views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions import text as X
from peerlens.operators.grouped import as_list, row_positions, with_group_stats


def keep_first(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """First row per key by an explicit order, as an aggregate that combines map-side."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def row_id(df: DataFrame, order: Sequence[Column], name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1 in a total order."""
    return row_positions(df, order, name)


def fill_group_mean(df: DataFrame, group: str, key, col: str) -> DataFrame:
    """NULL to the mean of the group; stays NULL where the whole group is NULL."""
    filled = with_group_stats(df, group, key, [F.avg(col).alias("_m")])
    return filled.withColumn(col, F.coalesce(F.col(col), F.col("_m"))).drop("_n", "_m")


def fill_train_mean(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL to the mean of the training rows."""
    cols = list(cols)
    cast = {c: F.col(c).cast("double") for c in cols}
    imputer = Imputer(strategy="mean", inputCols=cols, outputCols=[f"{c}_filled" for c in cols])
    return imputer.fit(train.withColumns(cast)).transform(df.withColumns(cast))


def noise_report(df: DataFrame, cols: Sequence[str], max_null: float = 0.9) -> DataFrame:
    """One row per column: distinct values, NULL share, and whether the column carries nothing.

    One aggregation over all columns; at most one distinct value or more NULLs than ``max_null`` is noise.
    """
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"), F.count(c).alias(f"{c}__n")]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    entry = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(f"{c}__n") > 0).cast("int").alias("some"),
            F.coalesce(F.col(f"{c}__lo") != F.col(f"{c}__hi"), F.lit(False)).cast("int").alias("varies"),
            (1 - F.col(f"{c}__n") / F.col("_rows")).alias("null_ratio"),
        )
        for c in cols
    ]
    long = one.select(F.explode(F.array(*entry)).alias("_e")).select("_e.*")
    return long.withColumn("noise", ((F.col("varies") == 0) | (F.col("null_ratio") > max_null)).cast("int"))


def drop_noise(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> list[str]:
    """Feature columns that are informative in both tables; the report has one row per column."""
    bad = set()
    for df in (train, test):
        bad |= {r["column"] for r in noise_report(df, cols).where("noise = 1").collect()}
    return [c for c in cols if c not in bad]


def label_membership(candidates: DataFrame, truth: DataFrame, keys, name: str = "target") -> DataFrame:
    """1 for candidates that occur in the truth table."""
    hits = truth.select(*as_list(keys)).distinct().withColumn("_hit", F.lit(1))
    return candidates.join(hits, as_list(keys), "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def explode_labels(groups: DataFrame, group: str, positives: str, negatives: str, item: str) -> DataFrame:
    """(group, item, label): items of the positive list with 1, of the negative list with 0; empty lists give none."""
    pos = groups.select(group, F.explode(positives).alias(item), F.lit(1).alias("label"))
    neg = groups.select(group, F.explode(negatives).alias(item), F.lit(0).alias("label"))
    return pos.unionByName(neg)


def wide_features(ids: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join feature tables on the same keys; one shuffle of ``ids`` serves all joins.

    A table with a repeated key ends the job instead of repeating rows. The check is a count inside the
    partitions that the join needs anyway.
    """
    out = ids.repartition(*keys)
    for t in tables:
        out = out.join(_unique(t, list(keys)), list(keys), "left")
    return out


def _unique(table: DataFrame, keys: list[str]) -> DataFrame:
    counted = table.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    values = [c for c in table.columns if c not in keys]
    message = F.lit(f"repeated key ({', '.join(keys)}) in a feature table")
    checked = {c: F.when(F.col("_n") > 1, F.raise_error(message).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in values}
    return counted.withColumns(checked).drop("_n")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once; a feature table must have none before it is joined."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def scores_left(base: DataFrame, others: Sequence[DataFrame], keys, cols: Sequence[str]) -> DataFrame:
    """Score columns of several scorers next to the first; a pair that a scorer lacks scores 0."""
    out = base
    for o in others:
        out = out.join(o, as_list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def passage_views(rows: DataFrame, papers: DataFrame, *, max_words: int, passage_words: int) -> DataFrame:
    """Nine texts that can retrieve a paper, as (pid, view, text).

    ``rows`` has pid, question, body, answer, summary, title, abstract per (question, paper);
    ``papers`` has pid, title, abstract. The eight question views come from one pass over ``rows``.
    """
    q, a, s = (X.tagged(f, F.col(f)) for f in ("question", "answer", "summary"))
    b = X.tagged("body", X.remove_links("body"))
    ta = F.concat_ws(" ", X.tagged("title", F.col("title")), X.tagged("abstract", F.col("abstract")))
    glue = lambda *p: F.concat(*[x for c in p for x in (c, F.lit(" "))][:-1])
    views = {
        "question": q,
        "question_body": X.shorten(glue(q, b), max_words),
        "question_paper": glue(q, X.shorten(ta, passage_words)),
        "question_answer": glue(q, a),
        "question_summary": glue(q, s),
        "answer": a,
        "summary": s,
        "question_answer_summary": glue(q, a, s),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), c.alias("text")) for v, c in views.items()]))
    own = rows.select("pid", pairs.alias("_v")).select("pid", "_v.view", "_v.text")
    return own.unionByName(papers.select("pid", F.lit("paper").alias("view"), ta.alias("text"))).na.drop()
