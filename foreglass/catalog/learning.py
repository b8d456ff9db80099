"""Classifiers, clusters and tagging on ``embeddings``, ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from foreglass.catalog import register, table, text_table
from foreglass.functions import text as X
from foreglass.operators import features as T, learn as L, sampling as S, tagging as H, tokens as K
from foreglass.plans import jobs as J
from foreglass.scale import scratch_path, written_once


def labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))


# What a trained model says cannot be stated in SQL. These queries train on the whole
# tables and return what must hold of the result, which SQL can state.

LINEAR = ["perceptron", "sgd", "logistic", "ridge", "linear", "elastic_net", "svm"]
TREES = ["decision_tree", "random_forest", "gradient_boosting", "xgboost"]
SPLIT = """(select sum(floor(n * 0.2 + 0.5))::bigint as n from (select count(*) as n from embeddings group by label < 5))"""


def _trained_facts(spark, sf, models):
    """Per model: test rows, rows that got a class, and whether its accuracy is the share of hits."""
    outputs, summary = J.classification_experiment(labelled_vectors(spark, sf), "vec_id", "y", "embedding", models, 42)
    long = outputs.unpivot(["vec_id", "label"], models, "model", "answer")
    counts = long.groupBy("model").agg(
        F.count("*").alias("test_rows"),
        F.count_if(F.col("answer").isin(0, 1)).alias("classed_rows"),
        F.avg((F.col("answer") == F.col("label")).cast("double")).alias("hits"),
    )
    same = F.abs(F.col("accuracy") - F.col("hits")) < 1e-9
    return summary.join(counts, "model").select("model", "test_rows", "classed_rows", same.alias("scored"))


def _facts_sql(models):
    return " union all ".join(f"select '{m}' as model, n as test_rows, n as classed_rows, true as scored from {SPLIT}" for m in models)


@register("train_and_score_models", _facts_sql(LINEAR))
def train_and_score_models(spark, sf):
    """All linear classifiers on one split, scored in one pass."""
    return _trained_facts(spark, sf, LINEAR)


@register("train_and_score_trees", _facts_sql(TREES))
def train_and_score_trees(spark, sf):
    """All tree classifiers on one split."""
    return _trained_facts(spark, sf, TREES)


@register(
    "predict_with_saved_models",
    """select vec_id, true as same_logistic, true as same_ridge from embeddings""",
)
def predict_with_saved_models(spark, sf):
    """Models read back from files answer as they did when they were fitted."""
    folder = scratch_path(spark, "models")
    ready = L.with_vector(labelled_vectors(spark, sf).withColumnRenamed("y", "label"), "embedding")
    fitted = L.train_models(ready, ["logistic", "ridge"], save_to=folder)
    loaded = L.load_models(folder, ["logistic", "ridge"])
    both = L.predict(L.predict(ready.select("vec_id", "features"), fitted, "_fitted"), loaded, "_loaded")
    return both.select(
        "vec_id", *[(F.col(f"{m}_fitted") == F.col(f"{m}_loaded")).alias(f"same_{m}") for m in ("logistic", "ridge")]
    )


GRID_MODELS = LINEAR + TREES
GRID_TREES = 20

#: Test rows of each training set: a fifth of each class.
GRID_SIZES = """c as (select count(*) as n from labels join documents using (doc_id) where quality is not null group by quality),
    sizes(experiment, test_rows) as (
      select 'imbalanced', sum(floor(n * 0.2 + 0.5))::bigint from c union all
      select 'oversampled', (count(*) * floor(max(n) * 0.2 + 0.5))::bigint from c union all
      select 'undersampled', (count(*) * floor(min(n) * 0.2 + 0.5))::bigint from c)"""


def scored_facts(outputs, metrics, key, models):
    """Per run and model: test rows, whether the reported accuracy is the share of hits in the written rows, and whether it learned.

    A model has learned if over all runs it has more hits than always naming the larger
    class of the test rows.
    """
    share = outputs.groupBy(*key).agg(F.greatest(F.avg("y"), 1 - F.avg("y")).alias("larger"), F.count("*").alias("test_rows"))
    long = outputs.unpivot([*key, "y"], models, "model", "answer")
    hits = long.groupBy(*key, "model").agg(F.avg((F.col("answer") == F.col("y")).cast("double")).alias("hits"))
    facts = metrics.join(hits, [*key, "model"]).join(share, key)
    same = F.abs(F.col("accuracy") - F.col("hits")) < 1e-9
    runs = Window.partitionBy("model")  # a few rows
    learned = F.avg("hits").over(runs) > F.avg("larger").over(runs)
    return facts.select(*key, "model", "test_rows", same.alias("scored"), learned.alias("learned"))


@register(
    "experiment_grid",
    f"""with {GRID_SIZES} select experiment, seed, model, test_rows, true as scored, true as learned from sizes,
        (values (3), (33), (42)) s(seed), (values {', '.join(f"('{m}')" for m in GRID_MODELS)}) m(model)""",
)
def experiment_grid(spark, sf):
    """Three seeds x three training sets x all registered models, fitted together, every run scored."""
    rows = table(spark, sf, "labels").join(text_table(spark, sf), "doc_id")
    numbers = F.array(
        F.log1p("n_chars"),
        F.length(F.regexp_replace("text", r"[^%&*$#!|]", "")).cast("double"),
        (F.size(X.whitespace_tokens("text")) / F.greatest(F.col("n_chars"), F.lit(1))).cast("double"),
    )
    base = written_once(rows.select("doc_id", F.col("quality").alias("y"), numbers.alias("v")), "features")
    copies = S.resampled(base, "doc_id", "y", "oversample")
    datasets = {
        "imbalanced": base.select(F.col("doc_id").cast("string").alias("row_id"), "y", "v"),
        "oversampled": copies.select(F.concat_ws("-", "doc_id", "copy").alias("row_id"), "y", "v"),
        "undersampled": S.resampled(base, "doc_id", "y", "undersample").select(
            F.col("doc_id").cast("string").alias("row_id"), "y", "v"
        ),
    }
    outputs, metrics = J.experiment_grid(datasets, "row_id", "y", "v", GRID_MODELS, [3, 33, 42], GRID_TREES)
    return scored_facts(outputs, metrics, ["experiment", "seed"], GRID_MODELS)


@register("fold_scores", "select 3::bigint as folds, true as in_range, true as steady")
def fold_scores(spark, sf):
    """Three folds, each scored by a model that has not seen it."""
    ready = L.with_vector(labelled_vectors(spark, sf).withColumnRenamed("y", "label"), "embedding")
    scores = L.fold_scores(S.folds(ready, "vec_id", 3), "logistic", 3)
    return scores.select(
        "folds", F.col("accuracy_mean").between(0, 1).alias("in_range"), (F.col("accuracy_std") < 0.25).alias("steady")
    )


@register("kmeans_groups", "select vec_id, label, true as nearest from embeddings")
def kmeans_groups(spark, sf):
    """Every row sits with the centre that is nearest to it."""
    rows = L.with_vector(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    found, centres = L.kmeans_groups(rows, 10)
    apart = lambda c: F.aggregate(
        F.zip_with("embedding", F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    with_distance = found.withColumn("apart", F.array(*[apart(c) for c in centres]))
    own = F.get("apart", F.col("cluster"))
    return with_distance.select("vec_id", "label", (own <= F.array_min("apart") + 1e-6).alias("nearest"))


@register("mixture_groups", "select vec_id, label, true as likeliest, true as whole from embeddings")
def mixture_groups(spark, sf):
    """A row's group is its likeliest one, and the shares of all groups add up to one."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    found = L.mixture_groups(L.with_vector(rows, "e"), 3).withColumn("shares", vector_to_array("probability"))
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    return found.select(
        "vec_id",
        "label",
        (F.get("shares", F.col("cluster")) >= F.array_max("shares") - 1e-9).alias("likeliest"),
        (F.abs(total - 1) < 1e-6).alias("whole"),
    )


@register("principal_components", "select count(*) as n, true as centred, true as apart, true as ordered from embeddings")
def principal_components(spark, sf):
    """Components are centred, uncorrelated, and the first explains most."""
    rows = L.with_vector(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    found, shares = L.principal_components(rows, 2)
    points = found.select(L.vector_item("components", 0).alias("x"), L.vector_item("components", 1).alias("y"))
    return points.agg(
        F.count("*").alias("n"),
        (F.abs(F.avg("x")) + F.abs(F.avg("y")) < 1e-6).alias("centred"),
        (F.abs(F.corr("x", "y")) < 1e-6).alias("apart"),
        ((F.var_pop("x") >= F.var_pop("y")) & F.lit(1 >= shares[0] >= shares[1] > 0)).alias("ordered"),
    )


@register("topic_shares", "select doc_id, true as shares from documents")
def topic_shares(spark, sf):
    """Two topics over all words; a text's shares add up to one (none for a text without words)."""
    words = text_table(spark, sf).select("doc_id", X.word_tokens("text").alias("words"))
    total = F.aggregate("topics", F.lit(0.0), lambda s, x: s + x)
    found = L.topics(words, "words", 2)
    return found.select("doc_id", ((F.abs(total - 1) < 1e-6) | (F.size("words") == 0)).alias("shares"))


@register(
    "merged_features",
    r"""select doc_id as row_id, len(regexp_extract_all(text, '\S+'))::double as first, embedding[64]::double as last
        from documents join embeddings on doc_id = vec_id""",
)
def merged_features(spark, sf):
    """Text counts and vectors of the same ids side by side in one vector."""
    counts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.size(X.whitespace_tokens("text")).cast("double").alias("n_words"), "n_chars"
    )
    vectors = L.with_vector(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id"), "embedding", "v")
    merged = T.merge_features(counts, vectors.select("row_id", "v"), "row_id", ["n_words", "n_chars", "v"])
    return merged.select("row_id", L.vector_item("features", 0).alias("first"), L.vector_item("features", 65).alias("last"))


# ---- tagging ---------------------------------------------------------------

SENTENCE = ["doc_id", "sentence_no"]


def _word_tag(word):
    size = F.length(word)
    return F.when(size > 9, "B-p_o").when(size > 6, "I-p_o").when(size > 3, "B-p_t").otherwise("O")


def tagged_sentences(spark, sf):
    """Sentences as word arrays; a word's tag follows its length."""
    rows = K.sentences(text_table(spark, sf), "doc_id", "text")
    words = rows.select(*SENTENCE, X.whitespace_tokens("sentence").alias("words"))
    return words.withColumn("tags", F.transform("words", _word_tag))


def tagged_tokens(spark, sf):
    pairs = F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "t")
    return tagged_sentences(spark, sf).select(*SENTENCE, pairs).select(
        *SENTENCE, "pos", F.col("t.words").alias("word"), F.col("t.tags").alias("tag")
    )


TAGGED = r"""s as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as sentence_no from (select doc_id,
     list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
       lambda x: x <> '') as ss from documents)),
   w as (select doc_id, sentence_no, unnest(ws) as word, generate_subscripts(ws, 1) as pos from
     (select *, string_split_regex(lower(sentence), '\s+') as ws from s)),
   t as (select doc_id, sentence_no, pos, word, case when length(word) > 9 then 'B-p_o'
     when length(word) > 6 then 'I-p_o' when length(word) > 3 then 'B-p_t' else 'O' end as tag from w)"""

register(
    "tag_transitions",
    f"""with {TAGGED}, st as (select tag as to_tag, coalesce(lag(tag) over (partition by doc_id, sentence_no order by pos),
          '<s>') as from_tag from t), c as (select from_tag, to_tag, count(*) as n from st group by all)
        select from_tag, to_tag, n, round(n / sum(n) over (partition by from_tag), 6) as p from c""",
)(lambda spark, sf: H.transitions_of_arrays(tagged_sentences(spark, sf)).withColumn("p", F.round("p", 6)))

FOLDED = """f as (select *, case when count(*) over (partition by word) > 3 then word else '< unk >' end as folded from t)"""
register(
    "tag_emissions",
    f"""with {TAGGED}, {FOLDED}, c as (select tag, folded as word, count(*) as n from f group by all)
        select tag, word, n, round(n / sum(n) over (partition by tag), 6) as p from c""",
)(
    lambda spark, sf: H.emission_table(tagged_tokens(spark, sf), threshold=3).withColumn("p", F.round("p", 6))
)


def decoded(spark, sf, method, find=H.decode, keys=SENTENCE):
    sentences = written_once(tagged_sentences(spark, sf), "sentences")
    pairs = F.explode(F.arrays_zip("words", "tags")).alias("t")
    tokens = sentences.select(pairs).select(F.col("t.words").alias("word"), F.col("t.tags").alias("tag"))
    return find(sentences, keys, H.transitions_of_arrays(sentences), H.emission_table(tokens, threshold=3), method)


DECODED = f"""{TAGGED}, {FOLDED},
    st as (select tag as to_tag, coalesce(lag(tag) over (partition by doc_id, sentence_no order by pos), '<s>') as from_tag from t),
    sc as (select from_tag, to_tag, count(*) as n from st group by all),
    step as (select from_tag, to_tag, ln(n / sum(n) over (partition by from_tag)) as lp from sc),
    ec as (select tag, folded as word, count(*) as n from f group by all),
    em as (select tag, word, ln(n / sum(n) over (partition by tag)) as lp from ec),
    tags as (select distinct to_tag as tag from step),
    every as (select word, tag from (select distinct word from em) cross join tags),
    score as (select word, tag, coalesce(lp, ln(1e-9)) as lp from every left join em using (word, tag)),
    steps as (select a.tag as from_tag, b.tag as to_tag, coalesce(lp, ln(1e-9)) as lp
      from (select tag from tags union all select '<s>') a cross join tags b left join step on from_tag = a.tag and to_tag = b.tag),
    tok as (select doc_id, sentence_no, pos, word, folded from f)"""

VITERBI = f"""{DECODED},
    walk as (
      select doc_id, sentence_no, pos, s.tag, s.lp + p.lp as lp, [s.tag] as path from tok join score s on s.word = folded
        join steps p on p.from_tag = '<s>' and p.to_tag = s.tag where pos = 1
      union all
      select tok.doc_id, tok.sentence_no, tok.pos, s.tag, max(w.lp + p.lp) + any_value(s.lp),
             list_append(arg_max(w.path, w.lp + p.lp), s.tag)
      from walk w join tok on tok.doc_id = w.doc_id and tok.sentence_no = w.sentence_no and tok.pos = w.pos + 1
        join score s on s.word = tok.folded join steps p on p.from_tag = w.tag and p.to_tag = s.tag
      group by tok.doc_id, tok.sentence_no, tok.pos, s.tag),
    ends as (select doc_id, sentence_no, max(pos) as pos from tok group by all),
    best as (select doc_id, sentence_no, arg_max(path, lp) as path from walk join ends using (doc_id, sentence_no, pos) group by all),
    tagged as (select doc_id, sentence_no, pos, word, path[pos] as predicted_tag from tok join best using (doc_id, sentence_no))"""

GREEDY = f"""{DECODED},
    walk as (
      select doc_id, sentence_no, pos, arg_max(s.tag, s.lp + p.lp) as tag from tok join score s on s.word = folded
        join steps p on p.from_tag = '<s>' and p.to_tag = s.tag where pos = 1 group by all
      union all
      select tok.doc_id, tok.sentence_no, tok.pos, arg_max(s.tag, p.lp + s.lp)
      from walk w join tok on tok.doc_id = w.doc_id and tok.sentence_no = w.sentence_no and tok.pos = w.pos + 1
        join score s on s.word = tok.folded join steps p on p.from_tag = w.tag and p.to_tag = s.tag
      group by tok.doc_id, tok.sentence_no, tok.pos)"""

PLACES = "doc_id, sentence_no::int as sentence_no, (pos - 1)::int as pos"
register("viterbi_tags", f"with recursive {VITERBI} select {PLACES}, word, predicted_tag from tagged")(
    lambda spark, sf: decoded(spark, sf, "viterbi")
)
register(
    "greedy_tags",
    f"with recursive {GREEDY} select {PLACES}, word, tag as predicted_tag from walk join tok using (doc_id, sentence_no, pos)",
)(lambda spark, sf: decoded(spark, sf, "greedy"))
register(
    "tag_accuracy",
    f"""with recursive {VITERBI} select count(*) as tokens, round(avg((tag = predicted_tag)::int), 6) as accuracy
        from t join tagged using (doc_id, sentence_no, pos)""",
)(
    lambda spark, sf: H.array_accuracy(decoded(spark, sf, "viterbi", H.decoded_arrays, ["tags"])).withColumn(
        "accuracy", F.round("accuracy", 6)
    )
)
