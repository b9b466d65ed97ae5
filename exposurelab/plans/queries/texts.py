"""Text scores, terms, sequences, vectors and classification of documents."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import tokens as tk
from ...functions.columns import bind
from ...operators import classify, explore, scorer, text as tx, textmodel
from ...operators.skew import lookup
from ...session import scratch_path
from ...sources.sinks import materialize
from .exploring import draw_sql
from .registry import Tables, query, rounded


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, for tables that are read more than once."""
    return materialize(rows, scratch_path(rows.sparkSession, name))


# Fixed values of these queries; the operators take any list.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "by", "on", "with", "for", "as", "it", "this", "be"]
NUM_WORDS = 20_000
CLASSES = [0, 1]
RANGES = [(1, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3), (1, 4), (1, 5), (1, 6)]
ALPHAS = [math.exp(-2 + i / 10) for i in range(40)]

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"
TOKENS = (
    r"list_filter(regexp_extract_all(regexp_replace(lower(text), '(^|[^A-Za-z0-9_!@#$%&*])@\w+', '\1 ', 'g'), "
    r"'\w+://\S+|#?[\p{L}\p{N}_]+(?:[''-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}]'), lambda w: not regexp_matches(w, '^\w+://'))"
)
KEPT = f"list_filter({TOKENS}, lambda w: w not in ({', '.join(repr(w) for w in STOP_WORDS)}))"

LEXICON = f"""
word_rows as (select doc_id, unnest({WORDS}) as token from documents),
counts as (select doc_id, token, count(*) as n from word_rows group by all),
lexicon as (select token, 4.0 * (sum(n) filter (where quality = 1) - coalesce(sum(n) filter (where quality = 0), 0)) / (sum(n) + 10) as valence,
                   avg(cast(toxic as double)) as subjectivity
            from counts join labels using (doc_id) group by token having sum(n) filter (where quality = 1) > 0),
scored as (select doc_id, coalesce(sum(n * valence), 0) as s, coalesce(sum(n * subjectivity) / sum(n) filter (where valence is not null), 0) as subjectivity
           from counts left join lexicon using (token) group by doc_id),
polarity as (select doc_id, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) as polarity, coalesce(subjectivity, 0) as subjectivity
             from documents left join scored using (doc_id))
"""


def labelled_words(t: Tables) -> DataFrame:
    """Words of the labelled documents, after the labels have picked the documents."""
    labelled = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    return tx.term_occurrences(labelled, "doc_id", tk.words("text"), keep=["quality", "toxic"]).withColumnRenamed("term", "token")


def lexicon(t: Tables) -> DataFrame:
    """Word valences learnt from the labels."""
    counts = labelled_words(t)
    good = F.sum(F.when(F.col("quality") == 1, F.col("n")))
    bad = F.coalesce(F.sum(F.when(F.col("quality") == 0, F.col("n"))), F.lit(0))
    # The mean over the documents that have the word.
    toxic = F.sum(F.col("first") * F.col("toxic")) / F.sum(F.when(F.col("toxic").isNotNull(), F.col("first")))
    words = counts.groupBy("token").agg(
        (F.lit(4.0) * (good - bad) / (F.sum("n") + 10)).alias("valence"),
        toxic.alias("subjectivity"),
        good.alias("good"),
    ).filter("good > 0").drop("good")
    # A lexicon is an input; written once, it is not learnt again at every use.
    return stored(words, "lexicon")


def polarity(t: Tables) -> DataFrame:
    return tx.polarity(t.texts, "doc_id", "text", lexicon(t))


@query(f"with {LEXICON} select doc_id, round(polarity, 6) as polarity, round(subjectivity, 6) as subjectivity from polarity")
def lexicon_polarity(t):
    return rounded(polarity(t))


@query(f"""with {LEXICON},
joint as (select quality, 'polarity' as name, polarity as v from labels left join polarity using (doc_id)
          union all select quality, 'subjectivity', subjectivity from labels left join polarity using (doc_id))
select quality, name, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min,
       round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75,
       round(max(v), 6) as max from joint group by quality, name""")
def scores_by_label(t):
    return rounded(tx.scores_by_label(polarity(t), t.labels, "doc_id", "quality", ["polarity", "subjectivity"]))


@query(f"""
with token_rows as (select doc_id, unnest({TOKENS}) as token, generate_subscripts({TOKENS}, 1) as pos from documents),
stems as (select distinct token, regexp_replace(token, '(ing|ed|s)$', '') as stem from token_rows where length(token) > 4),
stemmed as (select doc_id, pos, coalesce(stem, token) as token from token_rows left join stems using (token))
select doc_id, count(*) as n, md5(string_agg(token, ' ' order by pos)) as tokens from stemmed group by doc_id""")
def tokenize_posts(t):
    rows = tx.stem_tokens(t.texts, "doc_id", "text")
    stems = (
        rows.filter(F.length("token") > 4)
        .select("token", F.regexp_replace("token", "(ing|ed|s)$", "").alias("stem"))
        .distinct()
    )
    stems = stored(stems, "stems")
    packed = tx.stemmed_texts(t.texts, "doc_id", "text", stems)
    return packed.select(
        "doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens")
    )


def grams_sql(low: int, high: int, source: str, carry: str = "doc_id") -> str:
    """Rows (carry, size, term) for every n-gram of the kept tokens."""
    parts = [
        f"""select {carry}, {n} as size, unnest(list_transform(range(1, len(toks) - {n} + 2), lambda i: array_to_string(toks[i:i + {n - 1}], ' '))) as term
            from {source} where len(toks) >= {n}"""
        for n in range(low, high + 1)
    ]
    return " union all ".join(parts)


@query(f"""
with k as (select doc_id, {KEPT} as toks from documents),
g as ({grams_sql(1, 2, 'k')})
select size, term, count(*) as n, count(distinct doc_id) as n_docs from g group by size, term""")
def term_counts(t):
    tokens = tk.drop_words(tk.post_tokens("text"), STOP_WORDS)
    rows = [
        tx.term_occurrences(t.texts, "doc_id", bind(tokens, lambda arr: tk.ngrams(arr, n))).withColumn("size", F.lit(n))
        for n in (1, 2)
    ]
    counts = rows[0].unionByName(rows[1]).groupBy("size", "term").agg(F.sum("n").alias("n"), F.sum("first").alias("n_docs"))
    return counts.select("size", "term", "n", "n_docs")


@query(f"""
with k as (select doc_id, {KEPT} as toks from documents),
g as ({grams_sql(1, 6, 'k')})
select doc_id, size, count(*) as n, count(distinct term) as n_terms from g group by doc_id, size""")
def ngram_counts(t):
    return tx.ngram_totals(t.texts, "doc_id", "text", 1, 6, STOP_WORDS)


# ---- classification -------------------------------------------------------------------

def labelled(t: Tables) -> DataFrame:
    """Labelled documents with their part of the split and their fold."""
    split = explore.split(t.labels.select("doc_id", "quality"), "doc_id")
    return split.withColumn("fold", explore.fold_of("doc_id", 5))


def labelled_terms(t: Tables, high: int) -> tuple[DataFrame, DataFrame]:
    docs = labelled(t)
    kept = ["quality", "is_test", "fold"]
    tokens = tx.prepare_terms(t.texts.join(lookup(docs), "doc_id"), "text", STOP_WORDS).select("doc_id", *kept, "tokens")
    # Read by every round of counting: tokenize and hash once.
    return docs, stored(tx.ngram_occurrences(tokens, "doc_id", "tokens", 1, high, keep=kept, listed=True), "tokens")


# Terms of one partition of a count, which fit a task's memory, and the most rounds that a count is dealt over.
PARTITION_TERMS = 2_000_000
COUNT_ROUNDS = 6


def dealt(counts: DataFrame) -> dict[str, int]:
    """Partitions and rounds for the terms of texts in the listed form."""
    terms = counts.agg(F.sum(F.size("words") * (F.col("high") - F.col("low") + 1))).first()[0] or 0
    cores = counts.sparkSession.sparkContext.defaultParallelism
    partitions = max(cores, math.ceil(terms / PARTITION_TERMS))
    return {"partitions": partitions, "rounds": min(COUNT_ROUNDS, math.ceil(partitions / cores))}


def predictions(t: Tables, **options) -> DataFrame:
    docs, counts = labelled_terms(t, 1)
    return classify.naive_bayes(docs, counts, "doc_id", "quality", CLASSES, **dealt(counts), **options)


LABELLED = f"""
docs as (select doc_id, quality, {draw_sql('doc_id')} < 0.25 as is_test, cast(floor({draw_sql('doc_id', 'fold')} * 5) as int) as fold from labels),
kept as (select d.doc_id, quality, is_test, fold, {KEPT} as toks from documents join docs d using (doc_id))
"""


def predict_sql(alpha: float = 1.0, prior: bool = True) -> str:
    p = lambda c: f"ln((select count(*) from docs where not is_test and quality = {c}) / (select count(*) from docs where not is_test))" if prior else "0"
    return f"""
with {LABELLED},
rows_ as ({grams_sql(1, 1, 'kept', 'doc_id, quality, is_test')}),
tf as (select doc_id, is_test, quality, term, count(*) as n from rows_ group by all),
terms as (select term, coalesce(sum(n) filter (where quality = 0), 0) as c0, coalesce(sum(n) filter (where quality = 1), 0) as c1
          from tf where not is_test group by term),
tot as (select sum(c0) as n0, sum(c1) as n1, count(*) as v from terms),
s as (select doc_id, sum(n) as m, sum(n * ln(c0 + {alpha})) as s0, sum(n * ln(c1 + {alpha})) as s1
      from tf join terms using (term) where is_test group by doc_id),
sc as (select doc_id, quality, coalesce(s0, 0) - coalesce(m, 0) * ln(n0 + {alpha} * v) + {p(0)} as score_0,
              coalesce(s1, 0) - coalesce(m, 0) * ln(n1 + {alpha} * v) + {p(1)} as score_1
       from docs left join s using (doc_id), tot where is_test),
pred as (select *, case when score_1 > score_0 then 1 else 0 end as predicted from sc)
"""


@query(predict_sql() + "select doc_id, quality, predicted, round(score_0, 4) as score_0, round(score_1, 4) as score_1 from pred")
def nb_predict(t):
    return rounded(predictions(t), 4)


@query(predict_sql(0.5, prior=False) + "select doc_id, quality, predicted, round(score_0, 4) as score_0, round(score_1, 4) as score_1 from pred")
def nb_predict_uniform(t):
    return rounded(predictions(t, alpha=0.5, fit_prior=False), 4)


@query(predict_sql() + """
select a.x as quality, b.x as predicted, count(pred.doc_id) as n from (values (0), (1), (2)) a(x) cross join (values (0), (1), (2)) b(x)
left join pred on pred.quality = a.x and pred.predicted = b.x group by all""")
def confusion(t):
    return classify.confusion(predictions(t), "quality", "predicted", [0, 1, 2])


@query(predict_sql() + "select round(avg(cast(quality = predicted as int)), 6) as accuracy from pred")
def accuracy(t):
    return rounded(classify.accuracy(predictions(t), "quality", "predicted"))


def all_terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labelled documents and their terms of all n-gram sizes in the grid."""
    return labelled_terms(t, max(high for _, high in RANGES))


def grid(docs: DataFrame, counts: DataFrame | classify.Known) -> DataFrame:
    train = ~F.col("is_test")
    options = {}
    if isinstance(counts, DataFrame):
        counts = counts.filter(train)
        options = dealt(counts)
    return classify.naive_bayes_grid(
        docs.filter(train), counts, "doc_id", "quality", CLASSES, RANGES, ALPHAS, **options
    )


GRID = f"""
with {LABELLED},
train as (select * from docs where not is_test),
ktrain as (select * from kept where not is_test),
rows_ as ({grams_sql(1, 6, 'ktrain', 'doc_id, quality, fold')}),
tf as (select doc_id, fold, quality, size, term, count(*) as n from rows_ group by all),
folds as (select unnest(range(0, 5)) as fold),
alphas as (select i as alpha_index, exp(-2 + i / 10.0) as alpha from range(0, 40) r(i)),
ranges as (select * from (values {', '.join(str(r) for r in RANGES)}) r(low, high)),
terms as (select term, size, coalesce(sum(n) filter (where quality = 0), 0) as c0, coalesce(sum(n) filter (where quality = 1), 0) as c1 from tf group by all),
by_fold as (select term, fold, coalesce(sum(n) filter (where quality = 0), 0) as c0, coalesce(sum(n) filter (where quality = 1), 0) as c1 from tf group by all),
outside as (select t.term, t.size, f.fold, t.c0 - coalesce(b.c0, 0) as c0, t.c1 - coalesce(b.c1, 0) as c1
            from terms t cross join folds f left join by_fold b on b.term = t.term and b.fold = f.fold),
stat as (select low, high, fold, sum(c0) as n0, sum(c1) as n1, count(*) filter (where c0 + c1 > 0) as v
         from outside join ranges on size between low and high group by all),
sums as (select tf.doc_id, tf.size, alpha_index, sum(n) as m, sum(n * ln(o.c0 + alpha)) as s0, sum(n * ln(o.c1 + alpha)) as s1
         from tf join outside o on o.term = tf.term and o.fold = tf.fold and o.c0 + o.c1 > 0 cross join alphas group by all),
per_range as (select doc_id, low, high, alpha_index, sum(m) as m, sum(s0) as s0, sum(s1) as s1
              from sums join ranges on size between low and high group by all),
prior as (select f.fold, (select count(*) from train t where t.fold <> f.fold and quality = 0) as d0,
                 (select count(*) from train t where t.fold <> f.fold and quality = 1) as d1 from folds f),
sc as (select d.quality, d.fold, low, high, alpha_index, alpha, ln(d0 / (d0 + d1)) as p0, ln(d1 / (d0 + d1)) as p1,
              coalesce(s0, 0) - coalesce(m, 0) * ln(n0 + alpha * v) as w0, coalesce(s1, 0) - coalesce(m, 0) * ln(n1 + alpha * v) as w1
       from train d cross join ranges cross join alphas left join per_range using (doc_id, low, high, alpha_index)
       join stat using (low, high, fold) join prior on prior.fold = d.fold),
hits as (select low, high, alpha_index, alpha, fold, true as fit_prior, avg(cast((case when w1 + p1 > w0 + p0 then 1 else 0 end) = quality as int)) as a from sc group by all
         union all select low, high, alpha_index, alpha, fold, false, avg(cast((case when w1 > w0 then 1 else 0 end) = quality as int)) from sc group by all),
grid as (select low, high, alpha_index, alpha, fit_prior, avg(a) as mean_accuracy from hits group by all)
"""


@query(GRID + "select low, high, cast(alpha_index as int) as alpha_index, round(alpha, 6) as alpha, fit_prior, round(mean_accuracy, 4) as mean_accuracy from grid")
def nb_grid(t):
    return grid(*all_terms(t)).select(
        "low", "high", "alpha_index", F.round("alpha", 6).alias("alpha"), "fit_prior", F.round("mean_accuracy", 4).alias("mean_accuracy")
    )


BEST = GRID + """, best as (
select * from grid order by round(mean_accuracy, 9) desc, low, high, alpha_index, fit_prior desc limit 1)
"""


@query(BEST + "select low, high, cast(alpha_index as int) as alpha_index, round(alpha, 4) as alpha, fit_prior, round(mean_accuracy, 4) as mean_accuracy from best")
def nb_best(t):
    return rounded(classify.best_setting(grid(*all_terms(t))), 4)


BEST_CONFUSION = BEST + f""",
brows as ({grams_sql(1, 6, 'kept', 'doc_id, quality, is_test')}),
btf as (select doc_id, is_test, quality, term, count(*) as n from brows, best where size between low and high group by all),
bterms as (select term, coalesce(sum(n) filter (where quality = 0), 0) as c0, coalesce(sum(n) filter (where quality = 1), 0) as c1
           from btf where not is_test group by term),
btot as (select sum(c0) as n0, sum(c1) as n1, count(*) as v from bterms),
bsums as (select doc_id, sum(n) as m, sum(n * ln(c0 + alpha)) as s0, sum(n * ln(c1 + alpha)) as s1
          from btf join bterms using (term), best where is_test group by doc_id),
bprior as (select ln(count(*) filter (where quality = 0) / count(*)) as p0, ln(count(*) filter (where quality = 1) / count(*)) as p1 from train),
bscores as (select docs.quality, coalesce(s0, 0) - coalesce(m, 0) * ln(n0 + alpha * v) + case when fit_prior then p0 else 0 end as w0,
                   coalesce(s1, 0) - coalesce(m, 0) * ln(n1 + alpha * v) + case when fit_prior then p1 else 0 end as w1
            from docs left join bsums using (doc_id), btot, best, bprior where is_test),
bpred as (select quality, case when w1 > w0 then 1 else 0 end as predicted from bscores)
select a.x as quality, b.x as predicted, count(bpred.quality) as n from (values (0), (1)) a(x) cross join (values (0), (1)) b(x)
left join bpred on bpred.quality = a.x and bpred.predicted = b.x group by all"""


@query(BEST_CONFUSION)
def nb_best_confusion(t):
    """The best setting of the grid, fitted to all training documents and held against the others."""
    docs, counts = all_terms(t)
    # The terms of the test documents are counted along, for the setting that is found.
    known = classify.count_terms(counts, "doc_id", "quality", CLASSES, **dealt(counts))
    best = classify.best_setting(grid(docs, known)).first()
    made = classify.naive_bayes(
        docs, known, "doc_id", "quality", CLASSES,
        alpha=best["alpha"], fit_prior=best["fit_prior"], sizes=(best["low"], best["high"]),
    )
    return classify.confusion(made, "quality", "predicted", CLASSES)


# ---- stems in the classifier, models that are stored --------------------------------------

STEMMED = f"list_filter(list_transform({TOKENS}, lambda w: case when length(w) > 4 then regexp_replace(w, '(ing|ed|s)$', '') else w end), lambda w: w not in ({', '.join(repr(w) for w in STOP_WORDS)}))"


def stem_table(t: Tables) -> DataFrame:
    """Stems of the labelled documents' tokens by a simple rule; a stem table is an input."""
    tokens = tx.stem_tokens(t.texts.join(lookup(t.labels.select("doc_id")), "doc_id", "left_semi"), "doc_id", "text")
    long = tokens.filter(F.length("token") > 4).select("token").distinct()
    return stored(long.select("token", F.regexp_replace("token", "(ing|ed|s)$", "").alias("stem")), "stems")


def stem_model(
    t: Tables, settings: textmodel.Settings, stems: DataFrame, tokens: DataFrame | None = None
) -> textmodel.TextModel:
    """Fitted to the training documents, stored, and read back."""
    train = t.texts.join(lookup(labelled(t).filter(~F.col("is_test"))), "doc_id")
    path = scratch_path(t.spark, "text-model")
    textmodel.fit_text_model(train, "doc_id", "text", "quality", settings, path, stems, tokens)
    return textmodel.load_text_model(t.spark, path)


def stem_predictions(
    t: Tables, settings: textmodel.Settings, stems: DataFrame, tokens: DataFrame | None = None
) -> DataFrame:
    test = labelled(t).filter("is_test").select("doc_id", "quality")
    texts = t.texts.join(lookup(test), "doc_id")
    made = textmodel.predict(stem_model(t, settings, stems, tokens), texts, "doc_id", "text", tokens)
    return made.join(test, "doc_id")


def stem_terms(t: Tables, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled documents and their stemmed terms of all n-gram sizes in the grid, with the tokens."""
    docs = labelled(t)
    texts = t.texts.join(lookup(docs), "doc_id")
    tokens = textmodel.prepared(texts, "doc_id", "text", stems, STOP_WORDS).join(lookup(docs), "doc_id")
    kept = ["quality", "is_test", "fold", "tokens"]
    high = max(high for _, high in RANGES)
    return docs, stored(tx.ngram_occurrences(tokens, "doc_id", "tokens", 1, high, keep=kept, listed=True), "tokens")


def stem_settings(**options) -> textmodel.Settings:
    return textmodel.Settings(tuple(CLASSES), tuple(STOP_WORDS), **options)


@query(predict_sql().replace(KEPT, STEMMED) + "select doc_id, quality, predicted, round(score_0, 4) as score_0, round(score_1, 4) as score_1 from pred")
def nb_stem_predict(t):
    return rounded(stem_predictions(t, stem_settings(), stem_table(t)), 4)


@query(GRID.replace(KEPT, STEMMED) + "select low, high, cast(alpha_index as int) as alpha_index, round(alpha, 6) as alpha, fit_prior, round(mean_accuracy, 4) as mean_accuracy from grid")
def nb_stem_grid(t):
    return grid(*stem_terms(t, stem_table(t))).select(
        "low", "high", "alpha_index", F.round("alpha", 6).alias("alpha"), "fit_prior", F.round("mean_accuracy", 4).alias("mean_accuracy")
    )


@query(BEST_CONFUSION.replace(KEPT, STEMMED))
def nb_stem_best_confusion(t):
    """The best setting of the grid with stems, refitted, stored, read back and held against the other documents."""
    stems = stem_table(t)
    docs, counts = stem_terms(t, stems)
    best = classify.best_setting(grid(docs, counts)).first()
    settings = stem_settings(low=best["low"], high=best["high"], alpha=best["alpha"], fit_prior=best["fit_prior"])
    return classify.confusion(stem_predictions(t, settings, stems, counts), "quality", "predicted", CLASSES)


# ---- a trained scorer -----------------------------------------------------------------------

BUCKET = "(('0x' || substr(md5(token), 1, 8))::bigint % 4096)"


@query(f"""
with word_rows as (select doc_id, unnest({WORDS}) as token from documents),
buckets as (select doc_id, {BUCKET} as bucket, count(*) as n from word_rows group by all),
model as (select bucket, ln((sum(n * toxic) + 1) / (sum(n * (1 - toxic)) + 1)) as w from buckets join labels using (doc_id) group by bucket),
logits as (select doc_id, sum(n * coalesce(w, 0)) / sum(n) as z from buckets left join model using (bucket) group by doc_id),
p as (select doc_id, 1 / (1 + exp(-coalesce(z, 0))) as p from documents left join logits using (doc_id))
select doc_id, case when p >= 0.5 then 'NEGATIVE' else 'POSITIVE' end as label, round(greatest(p, 1 - p), 6) as score from p""")
def hashed_scores(t):
    """Every document scored in the JVM from a stored table of bucket weights (here log odds of the labels)."""
    rows = t.texts.join(t.labels.select("doc_id", "toxic"), "doc_id")
    counts = rows.select("toxic", F.explode(scorer.word_buckets("text")).alias("bucket")).groupBy("bucket").agg(
        F.log((F.sum("toxic") + 1) / (F.sum(1 - F.col("toxic")) + 1)).alias("weight")
    )
    model = scorer.read_scorer(counts, scorer.BUCKETS).save(t.spark, scratch_path(t.spark, "scorer"))
    return rounded(t.texts.select("doc_id", model("text").alias("s")).select("doc_id", "s.label", "s.score"))


@query()
def trained_scorer(t):
    """A scorer fitted to the training documents, on those held out: predicted against toxic."""
    split = explore.split(t.labels.select("doc_id", "toxic"), "doc_id")
    rows = t.texts.join(split, "doc_id")
    model = scorer.train_scorer(rows.filter(~F.col("is_test")), "text", F.col("toxic") == 1)
    held = rows.filter("is_test").select("toxic", (model("text")["label"] == "NEGATIVE").cast("int").alias("predicted"))
    return classify.confusion(held, "toxic", "predicted", [0, 1])


# ---- sequences ----------------------------------------------------------------------------

VOCAB = f"""
word_rows as (select doc_id, unnest({WORDS}) as token, generate_subscripts({WORDS}, 1) as pos from documents),
vocab as (select token, row_number() over (order by count(*) desc, token) as id from word_rows group by token
          order by count(*) desc, token limit 19999),
ids as (select doc_id, list(id order by pos) filter (where id is not null) as ids from word_rows left join vocab using (token) group by doc_id),
all_ids as (select doc_id, coalesce(ids, []) as ids from documents left join ids using (doc_id))
"""


def as_text(name: str):
    return F.array_join(F.transform(name, lambda i: i.cast("string")), ",").alias(name)


@query(f"with {VOCAB} select doc_id, len(ids) as n, md5(array_to_string(ids, ',')) as ids from all_ids")
def id_sequences(t):
    words = tk.words("text")
    ids = tx.encode(t.texts, "doc_id", words, tx.vocabulary(t.texts, words, NUM_WORDS), bound=NUM_WORDS)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(as_text("ids").cast("binary")).alias("ids"))


@query(f"""with {VOCAB}
select doc_id, array_to_string(list_concat(list_transform(range(0, greatest(30 - len(ids), 0)), lambda i: 0), ids[greatest(len(ids) - 29, 1):]), ',') as ids from all_ids""")
def padded_sequences(t):
    return tx.padded_sequences(t.texts, "doc_id", "text", NUM_WORDS, 30).select("doc_id", as_text("ids"))


@query(f"""with {VOCAB},
coded as (select doc_id, list(coalesce(id + 102, 100) order by pos) as ids from word_rows left join vocab using (token) group by doc_id),
every as (select doc_id, coalesce(ids, []) as ids from documents left join coded using (doc_id))
select doc_id, len(ids) > 218 as was_cut, least(len(ids), 218) + 2 as n_mask,
       array_to_string(list_concat([101], ids[1:218], [102], list_transform(range(0, greatest(218 - len(ids), 0)), lambda i: 0)), ',') as ids from every""")
def subword_sequences(t):
    words = tk.words("text")
    vocab = tx.vocabulary(t.texts, words, NUM_WORDS).withColumn("id", F.col("id") + 102)
    rows = tx.subword_sequences(t.texts, "doc_id", "text", vocab, begin=101, end=102, unknown=100, bound=NUM_WORDS)
    marks = F.aggregate("mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_mask")
    return rows.select("doc_id", "was_cut", marks, as_text("ids"))


@query("""
with c as (select lang, row_number() over (order by lang) - 1 as code from (select distinct lang from documents))
select doc_id, cast(code as int) as code, array_to_string(list_transform(range(0, (select count(*) from c)), lambda i: case when i = code then 1 else 0 end), ',') as one_hot
from documents join c using (lang)""")
def one_hot(t):
    return tx.one_hot(t.texts, "lang").select("doc_id", "code", as_text("one_hot"))


# ---- vectors and model scores --------------------------------------------------------------

def vectors(t: Tables) -> DataFrame:
    """The i-th most frequent word gets the i-th vector."""
    vocab = tx.vocabulary(t.texts, tk.words("text"), NUM_WORDS)
    return stored(vocab, "vocabulary").join(t.embeddings.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector")), "id")


@query(f"""with {VOCAB},
v as (select token, embedding from vocab join embeddings on vec_id + 1 = id),
long as (select doc_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as dim from word_rows join v using (token))
select doc_id, n_words, array_to_string(list(x order by dim), ',') as mean_vector from (
  select doc_id, dim, count(*) as n_words, cast(cast(floor(avg(cast(x as double)) * 10000 + 0.5) as bigint) as varchar) as x from long group by doc_id, dim)
group by doc_id, n_words""")
def mean_vector(t):
    means = tx.mean_vectors(t.texts, "doc_id", "text", vectors(t), 64)
    scaled = F.transform("mean_vector", lambda x: F.floor(x * 10000 + 0.5))
    return means.select("doc_id", "n_words", scaled.alias("mean_vector")).withColumn("mean_vector", as_text("mean_vector"))


@query(f"""
with word_rows as (select doc_id, unnest({WORDS}) as token from documents),
counts as (select doc_id, token, count(*) as n from word_rows group by all),
model as (select token, ln((sum(n * quality) + 1) / (sum(n * (1 - quality)) + 1)) as q, ln((sum(n * toxic) + 1) / (sum(n * (1 - toxic)) + 1)) as t
          from counts join labels using (doc_id) group by token),
hits as (select doc_id, sum(n * q) / sum(n) as q, sum(n * t) / sum(n) as t from counts join model using (token) group by doc_id)
select doc_id, round(1 / (1 + exp(-coalesce(q, 0))), 6) as quality, round(1 / (1 + exp(-coalesce(t, 0))), 6) as toxic
from documents left join hits using (doc_id)""")
def score_batch(t):
    """Two independent probabilities per document from the weights of all labelled words."""
    lean = lambda c: F.log((F.sum(F.col("n") * F.col(c)) + 1) / (F.sum(F.col("n") * (1 - F.col(c))) + 1)).alias(c)
    words = t.documents.select("doc_id", "text").join(t.labels, "doc_id").select("quality", "toxic", F.explode(tk.words("text")).alias("token"))
    model = stored(words.withColumn("n", F.lit(1).cast("long")).groupBy("token").agg(lean("quality"), lean("toxic")), "weights")
    return rounded(tx.linear_scores(t.texts, "doc_id", "text", model, ["quality", "toxic"]))
