"""Question -> ranked papers: passages, out-of-fold retrieval, labelled pairs, scoring, blend, ranked lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions import text as X
from peerlens.operators import models as MD
from peerlens.operators import neighbours as N
from peerlens.operators import rows as W
from peerlens.operators import splits as SP
from peerlens.runtime import pin

RETRIEVED, KEPT, EXPORTED = 1000, 100, 20  # fixed values of the task
PAIR_FEATURES = ["score", "position", "jaccard", "q_words", "p_words"]


def questions(raw: DataFrame, generated: DataFrame | None, *, folds: int = 4, max_words: int = 256) -> DataFrame:
    """q_id, question, body, answer, summary, fold and the query text; generated texts join on the question."""
    out = raw
    if generated is not None:
        kept = W.keep_first(generated.na.drop(subset=["question", "answer", "summary"]), "question", [F.col("answer"), F.col("summary")])
        out = out.join(kept, "question", "left")
    out = out.withColumns({c: X.shorten(F.coalesce(c, F.lit("")), max_words) for c in ("answer", "summary")})
    text = F.concat_ws(" ", *[X.tagged(c, F.col(c)) for c in ("question", "answer", "summary")])
    return SP.group_kfold(out.withColumn("query", text), "q_id", folds)


def passages(qs: DataFrame, truth: DataFrame, papers: DataFrame, *, max_words: int = 256) -> DataFrame:
    """(passage, pid, fold, text): question views of known pairs with their fold, paper texts with none.

    ``passage`` names the (paper, question, view).
    """
    pairs = qs.select("q_id", "question", "body", "answer", "summary", "fold").join(truth, "q_id").join(papers, "pid")
    for_view = W.passage_views(
        pairs.withColumn("pid", F.struct("pid", "q_id", "fold")),
        papers.withColumn("pid", F.struct("pid", F.lit(None).cast("long").alias("q_id"), F.lit(None).cast("long").alias("fold"))),
        max_words=max_words,
        passage_words=max_words,
    )
    known = for_view.select(F.col("pid.pid").alias("pid"), F.col("pid.q_id").alias("q_id"), F.col("pid.fold").alias("fold"), "view", "text")
    name = [F.col("pid").cast("string"), F.coalesce(F.col("q_id").cast("string"), F.lit("-")), F.col("view")]
    return known.withColumn("passage", F.concat_ws("|", *name))


def candidates(
    qs: DataFrame, pas: DataFrame, encoder: Callable, *, retrieved: int = RETRIEVED, kept: int = KEPT, search: Callable = N.knn_cosine
) -> DataFrame:
    """(q_id, pid, text, score, position): nearest passages of other folds, best passage per paper, first ``kept``.

    ``search`` is exact by default; ``knn_index.knn_index`` takes the same arguments.
    """
    q = pin(MD.batch_infer(qs, "q_id", "query", encoder, keep=["fold"]), "queries")
    p = pin(MD.batch_infer(pas, "passage", "text", encoder, keep=["pid", "fold"]), "passages")
    near = search(q, p, "q_id", "passage", "vector", "vector", retrieved, not_within=("fold", "fold"))
    owned = near.join(p.select(F.col("passage").alias("item"), "pid"), "item")
    best = W.keep_first(owned.select("q_id", "pid", "item", "score", "rank"), ["q_id", "pid"], [F.col("rank")])
    top = N.top_per_key(best.drop("score"), "q_id", [F.col("rank")], kept, rank="position")
    scored = top.join(best.select("q_id", "pid", "score"), ["q_id", "pid"])
    # Only the passages that were kept are split into words.
    terms = distinct_words(pas.join(scored.select(F.col("item").alias("passage")).distinct(), "passage", "left_semi"), "text").select(F.col("passage").alias("item"), "words", "n_words")
    return scored.join(terms, "item").drop("item", "rank")


def distinct_words(df: DataFrame, text: str) -> DataFrame:
    """Lower-case words of a text as a set (``words``), and their number with repeats (``n_words``)."""
    split = pin(df.withColumn("_w", X.words(F.lower(text))), "words")
    return split.withColumns({"words": F.array_distinct("_w"), "n_words": F.size("_w")}).drop("_w")


def pair_table(cands: DataFrame, qs: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with target and table features of the (query, passage) pair."""
    asked = distinct_words(qs.select("q_id", "query"), "query")
    asked = asked.select("q_id", F.col("words").alias("_qw"), F.col("n_words").alias("_qn")).join(qs.select("q_id", "fold"), "q_id")
    rows = W.label_membership(cands, truth, ["q_id", "pid"]).join(asked, "q_id")
    shared = F.size(F.array_intersect("_qw", "words"))
    either = F.size("_qw") + F.size("words") - shared
    return rows.select(
        "q_id",
        "pid",
        "fold",
        "target",
        F.col("score").cast("double").alias("score"),
        F.col("position").cast("double").alias("position"),
        F.coalesce(shared / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("jaccard"),
        F.col("_qn").cast("double").alias("q_words"),
        F.col("n_words").cast("double").alias("p_words"),
    )


def rank(pairs: DataFrame, *, feature_sets: Sequence[Sequence[str]], keep_negatives: float = 0.05, exported: int = EXPORTED) -> DataFrame:
    """Scorers fitted on down-sampled pairs, their mean, and the first ``exported`` papers per query.

    A pair is scored by models that were fitted on the questions of other folds.
    """
    pairs = pin(pairs, "pairs")
    train = pin(SP.negative_downsample(pairs, "q_id", "pid", "target", keep_negatives), "train")
    out = pairs.select("q_id", "pid", "target")
    # Folds whose models would see both classes; a fold number is a parameter of the split, so there are few.
    known = train.groupBy("fold").agg(F.max("target").alias("hit")).where("hit = 1").select("fold").collect()
    every = [r["fold"] for r in pairs.select("fold").distinct().collect()]
    folds = [f for f in sorted(every) if any(r["fold"] != f for r in known)]
    names = []
    for i, cols in enumerate(feature_sets):
        names.append(f"pred{i + 1}")
        scored = None
        for fold in folds:
            model = MD.pair_scorer(list(cols)).fit(train.where(F.col("fold") != fold))
            part = MD.predict(model, pairs.where(F.col("fold") == fold), names[-1]).select("q_id", "pid", names[-1])
            scored = part if scored is None else scored.unionByName(part)
        if scored is not None:
            out = out.join(scored, ["q_id", "pid"], "left")
    mean = sum((F.coalesce(F.col(n), F.lit(0.0)) if folds else F.lit(0.0) for n in names), F.lit(0.0)) / len(names)
    return N.top_per_key(out.withColumn("pred", F.round(mean, 9)), "q_id", [F.desc("pred"), F.col("pid")], exported)
