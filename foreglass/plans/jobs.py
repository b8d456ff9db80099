"""Whole jobs, composed of the operators; each stays one lazy plan where it can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foreglass.functions import replies as P, text as X
from foreglass.operators import (
    evaluate as E,
    experiments as XP,
    features as T,
    learn as L,
    many_fits as M,
    profile as PR,
    relational as R,
    retrieve as G,
    sampling as S,
    tokens as K,
)
from foreglass.scale import written_once
from foreglass.sources import scans as SC, sinks as W

SUMMARY = ["accuracy", *[f"{v}_class_{c}" for v in ("precision", "recall", "f1") for c in (0, 1)], "auc"]


def clean_text(column) -> object:
    """The cleaning steps in their fixed order."""
    steps = (
        X.lower_case,
        X.strip_markup_and_urls,
        X.expand_contractions,
        X.letters_only,
        X.drop_symbols,
        X.squeeze_blanks,
    )
    for step in steps:
        column = step(column)
    return column


def future_sentences(documents: DataFrame, row_id: str, text: str, modal_words: list[str]) -> DataFrame:
    """Sentences with their future flag, tested inside the row: nothing is shuffled."""
    rows = K.sentences(documents, row_id, text)
    words = rows.withColumn("_words", X.whitespace_tokens("sentence")).filter(F.size("_words") > 0)
    return words.withColumn("is_future", K.has_cue(F.col("_words"), modal_words)).drop("_words")


def tense_run(documents: DataFrame, row_id: str, text: str, modal_words: list[str], folder: str, prefix: str) -> DataFrame:
    """One run of the tense job: flag, check the count, save the next version; gives the run record.

    Every sentence with words must have come out flagged.
    """
    spark = documents.sparkSession
    path = W.save_versioned(future_sentences(documents, row_id, text, modal_words), folder, prefix, "parquet")
    saved = spark.read.parquet(path)
    sentences = K.sentences(documents, row_id, text).filter(F.size(X.whitespace_tokens("sentence")) > 0)
    K.require_rows(saved, sentences.count())
    return SC.run_record(saved, "is_future", "modal words")


def latest_runs(spark, folder: str, schema) -> DataFrame:
    """The rows of the newest version of every prefix below a folder, stacked by name."""
    files = SC.list_files(spark, folder).select(F.regexp_extract("path", r"^(.*-v\d+)/[^/]*\.parquet$", 1).alias("p")).filter("p <> ''")
    newest = SC.latest_files(files.distinct().select(F.concat("p", F.lit(".run")).alias("path")))
    paths = [r["path"].removesuffix(".run") for r in newest.collect()]
    return R.union_by_name(*[spark.read.schema(schema).parquet(p) for p in sorted(paths)])


def text_experiment(
    texts: DataFrame,
    row_id: str,
    text: str,
    label: str,
    dataset: str,
    word_vectors: DataFrame,
    size: int,
    models: list[str],
    seed: int,
    trees: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """The whole experiment on a named dataset: shuffle, pooled text features, split, train together, score."""
    chosen = R.require_columns(R.named_dataset(texts, dataset), [row_id, text, label])
    placed = R.shuffle_positions(chosen, row_id, seed)
    counted = T.term_index(placed, row_id, X.whitespace_tokens(text))
    vectors = T.pooled_vectors(counted, row_id, word_vectors, size)
    rows = R.attach(placed, vectors, ["vector"], row_id)
    return experiment_grid({dataset: rows}, row_id, label, "vector", models, [seed], trees)


def trained_outputs(
    df: DataFrame, row_id: str, label: str, vector: str, models: list[str], seed: int
) -> DataFrame:
    """Split, train all models, predict the test rows: ``(row_id, label, one column per model)``."""
    R.require_columns(df, [row_id, label, vector])
    marked = S.split_rows(df, row_id, 0.2, seed, [label])
    # the split rows are written once: every model and the test set read the same table
    ready = L.with_vector(written_once(marked.withColumn(L.LABEL, F.col(label)), "split"), vector)
    fitted = L.train_models(ready.filter("not is_test"), models, seed)
    test = ready.filter("is_test").select(row_id, L.LABEL, L.FEATURES)
    return L.predict(test, fitted, "").drop(L.FEATURES)


def classification_experiment(
    df: DataFrame, row_id: str, label: str, vector: str, models: list[str], seed: int
) -> tuple[DataFrame, DataFrame]:
    """One experiment from table to scores: ``(outputs, summary)``."""
    outputs = written_once(trained_outputs(df, row_id, label, vector, models, seed), "outputs")
    return outputs, E.evaluate_models(outputs, L.LABEL, models)


def grid_rows(datasets: dict[str, DataFrame], row_id: str, label: str, vector: str, seeds: list[int]) -> DataFrame:
    """Rows of all data sets as ``many_fits`` wants them, with ``experiment`` and ``row_id``; run ``i * seeds + j`` is seed j of set i."""
    runs, out = len(datasets) * len(seeds), []
    for i, (name, data) in enumerate(datasets.items()):
        marked = data.select(F.lit(name).alias("experiment"), row_id, F.col(label).alias("y"), F.col(vector).alias("x"))
        for j, seed in enumerate(seeds):
            marked = S.split_rows(marked, row_id, 0.2, seed, ["y"]).withColumnRenamed("is_test", f"_test_{j}")
        own = [F.when(F.col(f"_test_{j}"), -1).otherwise(1) for j in range(len(seeds))]
        before, after = i * len(seeds), runs - (i + 1) * len(seeds)
        part = F.array(*[F.lit(0)] * before, *own, *[F.lit(0)] * after)
        out.append(marked.select("experiment", row_id, "x", "y", part.alias("part"), F.xxhash64("experiment", row_id).alias("row")))
    every = reduce(DataFrame.unionByName, out)
    return every.filter("x is not null and y is not null").withColumns({"x": F.col("x").cast("array<double>"), "y": F.col("y").cast("double")})


def experiment_grid(
    datasets: dict[str, DataFrame], row_id: str, label: str, vector: str, models: list[str], seeds: list[int], trees: int = 100
) -> tuple[DataFrame, DataFrame]:
    """All models on every data set and seed, fitted together: ``(outputs, metrics)``.

    Data sets are split once for every seed and written as one table; each pass over it
    serves all runs (see ``many_fits``). ``outputs`` is the written table of
    ``experiment, seed, row_id, y`` and a column for each model; ``metrics`` has a row per
    experiment, seed and model.
    """
    rows = written_once(grid_rows(datasets, row_id, label, vector, seeds), "grid")
    names, runs = list(datasets), len(datasets) * len(seeds)
    found = M.fit_grid(rows, models, seeds * len(names), trees)
    told = M.answers(rows, ["experiment", row_id], found, models, runs)
    seed = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("run") % len(seeds) + 1)
    outputs = written_once(told.withColumn("seed", seed).select("experiment", "seed", row_id, "y", *models), "grid-outputs")
    pairs = outputs.unpivot(["experiment", "seed", "y"], models, "name", "predicted")
    key = F.concat_ws("|", "experiment", "seed", "name")
    counts = pairs.groupBy(key.alias("model"), F.col("y").alias("actual"), "predicted").agg(F.count("*").alias("n"))
    part = F.split("model", r"\|")
    metrics = E.summary_of_counts(counts).select(
        F.get(part, F.lit(0)).alias("experiment"),
        F.get(part, F.lit(1)).cast("int").alias("seed"),
        F.get(part, F.lit(2)).alias("model"),
        *SUMMARY,
    )
    return outputs, metrics


def average_experiments(runs: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest versions -> averages per experiment -> margins over datasets and models."""
    newest = XP.latest_versions(runs, ["experiment", "seed"])
    averaged = XP.average_runs(newest, ["experiment"], metrics)
    means = averaged.filter(~F.col("model").isin("mean_row", "std_row")).select(
        "experiment", "model", *[F.col(f"{m}_mean").alias(m) for m in metrics]
    )
    return averaged, XP.cross_dataset_margins(means, metrics), XP.accuracy_per_dataset(means, metrics[0])


def agreement_study(rated: DataFrame, row_id: str, label: str, groups: dict[str, list[str]]) -> DataFrame:
    """Majority vote per model group, then the quality of each vote against the label."""
    votes = rated.select(
        row_id, label, *[PR.majority_of_columns(models).alias(name) for name, models in groups.items()]
    )
    return E.binary_metrics(E.outcome_counts(votes, label, list(groups)))


def full_agreement_study(
    left: DataFrame, right: DataFrame, row_id: str, label: str, raters: list[str], groups: dict[str, list[str]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings kept in two tables: check that their rows agree, bind them, compare the raters.

    Gives the votes' quality per group, Cohen's kappa per pair and Fleiss' kappa over all.
    """
    facts = R.alignment(left, right, [label], row_id).first()
    if not facts["aligned"]:
        raise ValueError(f"{facts['different']} rows differ")
    rated = R.bind_columns(left, right.drop(label), row_id)
    return agreement_study(rated, row_id, label, groups), E.cohens_kappa(rated, raters), E.fleiss_kappa(rated, [label, *raters])


def certified_pairs(
    replies: DataFrame,
    query_id: str,
    reply: str,
    reports: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    k: int = 33,
) -> DataFrame:
    """Property replies -> query texts -> best reports -> judgements -> pairs judged 1.

    ``judge`` adds the judge's ``reply`` to the retrieved pairs ``(query_id, row_id,
    rank, score)``, for instance by joining a table of given replies.
    """
    parsed = replies.select(F.col(query_id).alias("query_id"), P.property_lists(reply).alias("p"))
    text = F.concat_ws(" ", "p.target", "p.date", "p.outcome")
    queries = T.counted_terms(parsed.select("query_id", text.alias("t")), "query_id", X.whitespace_tokens("t"))
    judged = judge(G.bm25_top_k(reports, queries, k)).withColumn("_j", P.judgement("reply"))
    return judged.filter("_j.label = 1").select("query_id", "row_id", "rank", "score")


def certified_lists(pairs: DataFrame) -> DataFrame:
    """The certified reports of every statement as one array, best first."""
    return R.matched_arrays(pairs, "query_id", "row_id", "rank", "reports")


def judged_posts(votes: DataFrame, keys: list[str], reply: str, order: list[str], posts: DataFrame) -> DataFrame:
    """Judge replies -> majority per post -> the posts with their verdict."""
    verdicts = PR.vote_verdicts(PR.judge_votes(votes, keys, reply, order), keys, order)
    return posts.join(verdicts, keys)


def labelled_posts(
    votes: DataFrame, keys: list[str], reply: str, order: list[str], posts: DataFrame, account: str, text: str, time: list[str]
) -> DataFrame:
    """The whole chain: equal rows once, account fields, first post per author and text, its verdict."""
    distinct = R.drop_duplicate_rows(posts)
    parsed = distinct.withColumn("_a", P.account_fields(account)).filter("_a is not null").select("*", "_a.*").drop("_a", account)
    first = R.keep_first(parsed, ["username", text], time)
    return judged_posts(votes, keys, reply, order, first)


def training_table(generated: DataFrame, observed: DataFrame, annotated: DataFrame, target: str) -> DataFrame:
    """Generated and human sentences in one table: ``(sentence, sentence_label, author_type, dataset)``."""
    columns = ["sentence", "sentence_label", "author_type", "dataset"]
    parts = [
        R.constant_columns(generated.dropna(), {"sentence_label": 1, "author_type": 0, "dataset": "generated"}),
        R.constant_columns(observed.dropna(), {"sentence_label": 0, "author_type": 0, "dataset": "generated"}),
        R.constant_columns(
            R.label_to_int(annotated.dropna(subset=["sentence"]), "label", target, "sentence_label"),
            {"author_type": 1, "dataset": "annotated"},
        ),
    ]
    return R.combine_sources(parts, columns)


def label_missing(table: DataFrame, new_labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """Keep labelled rows, give the others their new label if there is one, stack again."""
    done = table.filter(F.col(label).isNotNull())
    open_rows = R.keep_missing(table, label).drop(label)
    return R.union_by_name(done, R.attach(open_rows, new_labels, [label], row_id))


def label_missing_and_save(
    table: DataFrame, new_labels: DataFrame, row_id: str, label: str, folder: str, prefix: str
) -> str:
    return W.save_versioned(label_missing(table, new_labels, row_id, label), folder, prefix, "parquet")
