"""Codes, splits, oversampling, classifiers, reports and attributions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from billscope.operators import boosting, explain, models, perceptron, prep, tree_paths
from billscope.queries.registry import query, table

LABELLED = "(select labels.doc_id, lang, source, n_chars, quality, toxic from labels join documents on labels.doc_id = documents.doc_id)"


def labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id")


@query("m1_label_encode", f"""
with codes as (
  select lang, (row_number() over (order by lang) - 1)::int as code from (select distinct lang from {LABELLED} where lang <> 'es')
)
select doc_id, coalesce(code, (select count(*) from codes))::int as code, codes.lang as decoded
from {LABELLED} l left join codes on l.lang = codes.lang
""")
def m1_label_encode(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    codes = prep.code_table(rows.where("lang <> 'es'"), "lang")
    coded = prep.encode_labels(rows.select("doc_id", "lang"), "lang", codes, "code")
    return prep.decode_labels(coded.select("doc_id", "code"), "code", codes, "decoded")


@query("m2_code_table", """
select source as category, (row_number() over (order by source) - 1)::int as code from (select distinct source from documents)
""")
def m2_code_table(spark, sf_dir):
    return prep.code_table(table(spark, sf_dir, "documents"), "source")


SPLIT_SQL = f"""split as (
  select doc_id, toxic, n_chars, quality,
         row_number() over (partition by toxic order by md5(doc_id::varchar || '|42'), doc_id)
           <= floor(count(*) over (partition by toxic) * 0.2 + 0.5) as is_test
  from {LABELLED}
)"""


@query("m3_stratified_split", f"with {SPLIT_SQL} select doc_id, toxic, is_test from split")
def m3_stratified_split(spark, sf_dir):
    split = prep.stratified_split(labelled(spark, sf_dir), "toxic", ["doc_id"])
    return split.select("doc_id", "toxic", "is_test")


@query("m5_standardise", f"""
with {SPLIT_SQL}, s as (
  select avg(n_chars) as m1, stddev_pop(n_chars) as s1, avg(quality) as m2, stddev_pop(quality) as s2 from split where not is_test
)
select doc_id, round((n_chars - m1) / s1, 6) as n_chars, round((quality - m2) / s2, 6) as quality from split, s
""")
def m5_standardise(spark, sf_dir):
    split = prep.stratified_split(labelled(spark, sf_dir), "toxic", ["doc_id"])
    scaled = prep.standardise(split.where("not is_test"), split, ["n_chars", "quality"])
    return scaled.select("doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("quality", 6).alias("quality"))


@query("m4_smote")
def m4_smote(spark, sf_dir):
    return prep.smote(labelled(spark, sf_dir), "toxic", "doc_id", ["n_chars", "quality"], whole=["quality"])


@query("m4_smote_parity", f"""
select toxic, (select max(n) from (select count(*) as n from {LABELLED} group by toxic)) as n,
       count(*) as original, bool_and(n_chars between lo and hi) as inside
from {LABELLED} l join (select toxic as t, min(n_chars) as lo, max(n_chars) as hi from {LABELLED} group by 1) on toxic = t group by 1
""")
def m4_smote_parity(spark, sf_dir):
    """Class sizes after oversampling, and whether new rows stay within their class's range."""
    rows = labelled(spark, sf_dir)
    made = prep.smote(rows, "toxic", "doc_id", ["n_chars", "quality"], whole=["quality"])
    span = rows.groupBy(F.col("toxic").alias("t")).agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return made.join(span, made.toxic == span.t).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("synthetic")).alias("original"),
        F.bool_and(F.col("n_chars").between(F.col("lo"), F.col("hi"))).alias("inside"),
    )


def vector_rows(spark, sf_dir):
    """Embedding dimensions as columns, classes 0-2 against the rest, and a test mark."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") < 3).cast("int").alias("label"), (F.col("vec_id") % 2).cast("int").alias("period"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
    )
    return prep.stratified_split(rows, "label", ["vec_id"])


DIMENSIONS = [f"e{i}" for i in range(64)]


def train_and_test(spark, sf_dir, scaled=False):
    rows = vector_rows(spark, sf_dir)
    if scaled:
        rows = prep.standardise(rows.where("not is_test"), rows, DIMENSIONS)
    ready = models.assemble(rows, DIMENSIONS)
    return ready.where("not is_test"), ready.where("is_test")


@query("m6_logistic")
def m6_logistic(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir)
    return models.report(models.logistic(train, ["vec_id"]).transform(test))


@query("m6_report_adds_up", """
with c as (select (label < 3)::int as label, count(*) as n from embeddings group by 1), t as (select label, floor(n * 0.2 + 0.5)::bigint as s from c)
select label::varchar as class, s as support from t
union all select 'accuracy', sum(s)::bigint from t
union all select 'macro avg', sum(s)::bigint from t
union all select 'weighted avg', sum(s)::bigint from t
""")
def m6_report_adds_up(spark, sf_dir):
    """Test rows per class that a fitted model's report counts."""
    train, test = train_and_test(spark, sf_dir)
    model = models.logistic(train, ["vec_id"], strengths=(1.0,))
    return models.report(model.transform(test)).select("class", "support")


@query("m7_forest")
def m7_forest(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir)
    return models.report(models.forest(train, ["vec_id"]).transform(test))


@query("m8_boosted")
def m8_boosted(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir)
    search = models.boosted(train, ["vec_id"], trees=(10, 20, 30), depths=(3,), rates=(0.1, 0.3))
    return models.report(search.transform(test))


@query("m8_second_order")
def m8_second_order(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir)
    search = boosting.boosted_search(train, ["vec_id"], trees=(10, 20, 30), depths=(3,), rates=(0.1, 0.3))
    return models.report(search.transform(test))


STUMP = ["l_quantity", "l_discount", "l_tax"]


@query("m8_first_split", """
with v as (
  select unnest(['l_quantity', 'l_discount', 'l_tax']) as feature,
         unnest([l_quantity::double, l_discount::double, l_tax::double]) as x, (l_returnflag = 'R')::int as y from lineitem
), s as (select feature, x, sum(0.5 - y)::double as g, count(*) / 4 as h from v where x is not null and y is not null group by 1, 2),
c as (
  select feature, x, sum(g) over up as gl, sum(h) over up as hl,
         sum(g) over (partition by feature) as g, sum(h) over (partition by feature) as h
  from s window up as (partition by feature order by x)
), gains as (
  select *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) as gain from c where hl >= 1 and h - hl >= 1
)
select feature, x as threshold, round(-gl / (hl + 1), 8) as "left", round(-(g - gl) / (h - hl + 1), 8) as "right"
from gains order by gain desc limit 1
""")
def m8_first_split(spark, sf_dir):
    """The split with the highest second-order gain, and its leaves; each value of the columns has a bin."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(*[F.col(c).cast("double") for c in STUMP]).alias("features"),
    )
    search = boosting.boosted_search(rows, ["l_orderkey", "l_linenumber"], trees=(1,), depths=(1,), rates=(1.0,), folds=2, bins=128)
    nodes = spark.createDataFrame(search.bestModel.nodes(STUMP), "tree int, node int, feature string, threshold double, value double")
    return nodes.agg(
        F.max("feature").alias("feature"), F.max("threshold").alias("threshold"),
        F.round(F.max(F.when(F.col("node") == 1, F.col("value"))), 8).alias("left"),
        F.round(F.max(F.when(F.col("node") == 2, F.col("value"))), 8).alias("right"),
    )


@query("m9_mlp")
def m9_mlp(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir, scaled=True)
    return models.report(perceptron.perceptrons(train, ["vec_id"]).transform(test))


@query("m10_grid_search")
def m10_grid_search(spark, sf_dir):
    train, _ = train_and_test(spark, sf_dir)
    return models.search_table(models.logistic(train, ["vec_id"]))


@query("m13_period_models")
def m13_period_models(spark, sf_dir):
    train, test = train_and_test(spark, sf_dir)
    _, reports = models.period_reports(
        train, test, "period", [0, 1], models.fixed_forest
    )
    return reports


PREDICTED = f"(select toxic, (n_chars > 2000)::int as said from {LABELLED})"


@query("m11_report", f"""
with cells as (select toxic as t, said as p, count(*) as n from {PREDICTED} group by 1, 2),
ks as (select distinct unnest([t, p]) as k from cells),
c as (
  select k, coalesce(sum(n) filter (t = k), 0) as support, coalesce(sum(n) filter (p = k), 0) as said,
         coalesce(sum(n) filter (t = k and p = k), 0) as hit from cells, ks group by k
),
m as (
  select k, support::bigint as support, hit, coalesce(hit / nullif(said, 0), 0) as pr, coalesce(hit / nullif(support, 0), 0) as re from c
),
f as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f1 from m)
select k::varchar as class, round(pr, 8) as "precision", round(re, 8) as recall, round(f1, 8) as f1, support from f
union all
select 'accuracy', round(sum(hit) / sum(support), 8), round(sum(hit) / sum(support), 8), round(sum(hit) / sum(support), 8), sum(support)::bigint from f
union all
select 'macro avg', round(avg(pr), 8), round(avg(re), 8), round(avg(f1), 8), sum(support)::bigint from f
union all
select 'weighted avg', round(sum(pr * support) / sum(support), 8), round(sum(re * support) / sum(support), 8),
       round(sum(f1 * support) / sum(support), 8), sum(support)::bigint from f
""")
def m11_report(spark, sf_dir):
    judged = labelled(spark, sf_dir).select("toxic", (F.col("n_chars") > 2000).cast("int").alias("said"))
    out = models.report(judged, "toxic", "said")
    return out.select(
        "class", *[F.round(m, 8).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


@query("m12_confusion", f"""
select t as truth, p as predicted, count(toxic) as n
from (values (0), (1), (2)) a(t) cross join (values (0), (1), (2)) b(p) left join {PREDICTED} on toxic = t and said = p group by 1, 2
""")
def m12_confusion(spark, sf_dir):
    judged = labelled(spark, sf_dir).select("toxic", (F.col("n_chars") > 2000).cast("int").alias("said"))
    return models.confusion(judged, [0, 1, 2], "toxic", "said")


def attributed_model(spark, sf_dir, only=None):
    """A forest of 200 unlimited trees, the rows it is asked about (all, or one key) and their exact attributions."""
    train, test = train_and_test(spark, sf_dir)
    model = models.fixed_forest(train)
    rows = train.unionByName(test)
    if only is not None:
        rows = rows.where(F.col("vec_id") == F.lit(only))
    return model, rows, tree_paths.tree_attributions(model, rows, "vec_id", DIMENSIONS)


def attributed(spark, sf_dir, only=None):
    return attributed_model(spark, sf_dir, only)[2]


@query("m14_additivity", "select vec_id, true as adds_up from embeddings")
def m14_additivity(spark, sf_dir):
    """Whether base and attributions of each row add up to the model's probability."""
    model, rows, parts = attributed_model(spark, sf_dir)
    sums = parts.groupBy("vec_id").agg((F.sum("phi") + F.first("base")).alias("p"))
    said = model.transform(rows).select(F.col("vec_id").alias("_id"), F.get(vector_to_array("probability"), F.lit(1)).alias("q"))
    return sums.join(said, F.col("vec_id") == F.col("_id")).select("vec_id", (F.abs(F.col("p") - F.col("q")) < 1e-9).alias("adds_up"))


@query("m14_attribution")
def m14_attribution(spark, sf_dir):
    return attributed(spark, sf_dir)


@query("m15_top_features")
def m15_top_features(spark, sf_dir):
    return explain.top_features(attributed(spark, sf_dir))


@query("m16_row_breakdown")
def m16_row_breakdown(spark, sf_dir):
    """One row's steps; its attributions need the whole model, but no other row's."""
    return explain.row_breakdown(attributed(spark, sf_dir, only=3), "vec_id", 3)
