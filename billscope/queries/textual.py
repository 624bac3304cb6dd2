"""Text weights, vectors and cluster quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.functions import text, vectors
from billscope.operators import clusters, embed, kmeans, latent, tfidf
from billscope.plans import themes
from billscope.queries.registry import query, table, texts
from billscope.queries.scalars import PARTS_SQL

# Fixed value: a short stop-word list that the SQL can hold too.
STOP_WORDS = ["the", "of", "and", "to", "in", "le", "la", "de", "der", "die", "und", "el", "que", "los"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

TERMS_SQL = f"""terms as (
  select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents
), counted as (
  select doc_id, term, count(*) as tf from terms where term not in ({STOP_SQL}) group by 1, 2
)"""


@query("c1_tfidf", f"""
with {TERMS_SQL}, n as (select count(*) as n from documents),
kept as (
  select term, ln((1.0 + n) / (1.0 + df)) + 1 as idf
  from (select term, count(*) as df from counted group by 1), n where df >= 3 and df <= 0.8 * n
), w as (select doc_id, counted.term, tf * idf as w from counted join kept on counted.term = kept.term)
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w
""")
def c1_tfidf(spark, sf_dir):
    out = tfidf.tfidf(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", STOP_WORDS)
    return out.withColumn("weight", F.round("weight", 6))


@query("c2_stop_words", f"""
with {TERMS_SQL} select term, sum(tf)::bigint as n from counted group by 1
""")
def c2_stop_words(spark, sf_dir):
    terms = texts(spark, sf_dir).select(F.explode(tfidf.tokens(F.col("text"))).alias("term"))
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return tfidf.without_words(terms, "term", words).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("c3_encode")
def c3_encode(spark, sf_dir):
    documents = texts(spark, sf_dir)
    return embed.encode(documents, "text", size=64).select("doc_id", "vector")


def learned(spark, sf_dir) -> latent.Latent:
    return latent.fit(texts(spark, sf_dir), "text", words=STOP_WORDS)


@query("c3_latent_vectors")
def c3_latent_vectors(spark, sf_dir):
    """Vectors of all documents from the singular vectors of their own TF-IDF rows."""
    return learned(spark, sf_dir).encode(texts(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "vector")


@query("c3_latent_energy", f"""
with {TERMS_SQL}, n as (select count(*) as n from documents),
seen as (select term from counted, n group by term, n having count(*) >= 3 and count(*) <= 0.8 * n)
select d.doc_id, s.doc_id is not null as has_terms, true as within_length_one
from documents d left join (select distinct doc_id from counted join seen on counted.term = seen.term) s on d.doc_id = s.doc_id
""")
def c3_latent_energy(spark, sf_dir):
    """Which documents have a learned vector; the projection of a row of length one is never longer.

    Terms are told apart by hash; the SQL agrees as long as no document's only counted term owes
    its frequency to another one in its bucket.
    """
    rows = c3_latent_vectors(spark, sf_dir)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("doc_id", (length > 0).alias("has_terms"), (length <= 1 + 1e-9).alias("within_length_one"))


@query("c4_latent_similarity")
def c4_latent_similarity(spark, sf_dir):
    """How well a document's sub-texts match its themes, by vectors learned from all documents."""
    documents = texts(spark, sf_dir, "source", "lang").select(
        "doc_id", text.split_trim(F.col("text")).alias("sub_ementas"),
        F.array("source", "lang", F.lit("legislation"), F.lit("health and economy")).alias("tokens_temas"),
    )
    scored = themes.with_similarity(documents, learned(spark, sf_dir))
    return scored.select("doc_id", F.col("similaridade").alias("similarity"))


def profile_sql(value: str) -> str:
    return (
        f"list_transform(string_split('{embed.LETTERS}', ''), "
        f"lambda c: (length(lower({value})) - length(replace(lower({value}), c, '')))::double)"
    )


PARTS = f"(select doc_id, source, lang, {PARTS_SQL} as parts from documents)"


@query("c4_weighted_best_similarity", f"""
with p as (
  select doc_id, unnest(parts) as part, unnest(range(0, len(parts))) as i from {PARTS}
), pv as (
  select doc_id, i, length(part) as n, {profile_sql('part')} as v from p where doc_id % 10 <> 0
), t as (
  select doc_id, unnest([source, lang, 'legislation', 'health and economy']) as theme from documents
), tv as (select doc_id, {profile_sql('theme')} as v from t),
best as (
  select pv.doc_id, i, any_value(n) as n,
         max(case when list_sum(pv.v) = 0 or list_sum(tv.v) = 0 then 0 else list_cosine_similarity(pv.v, tv.v) end) as s
  from pv join tv on pv.doc_id = tv.doc_id group by pv.doc_id, i
), scored as (select doc_id, sum(s * n) / sum(n) as s from best group by 1)
select d.doc_id, round(coalesce(s, 0), 6) as similarity from documents d left join scored on d.doc_id = scored.doc_id
""")
def c4_weighted_best_similarity(spark, sf_dir):
    themes = F.when(
        F.col("doc_id") % 10 != 0, F.array(F.col("source"), F.col("lang"), F.lit("legislation"), F.lit("health and economy"))
    ).otherwise(F.array().cast("array<string>"))
    documents = texts(spark, sf_dir, "source", "lang").select(
        "doc_id", text.split_trim(F.col("text")).alias("parts"), themes.alias("themes")
    )
    scored = embed.weighted_best_similarity(
        documents, "parts",
        embed.letter_profiles(F.col("parts")), embed.letter_profiles(F.col("themes")),
    )
    return scored.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("j12_row_matrix", f"""
with p as (
  select doc_id, unnest(parts) as part, unnest(range(0, len(parts))) as i from {PARTS}
), pv as (select doc_id, i, {profile_sql('part')} as v from p),
t as (select doc_id, unnest([source, lang]) as theme, unnest([0, 1]) as j from documents),
tv as (select doc_id, j, {profile_sql('theme')} as v from t)
select pv.doc_id, i::int as part, j::int as theme,
       round(case when list_sum(pv.v) = 0 or list_sum(tv.v) = 0 then 0 else list_cosine_similarity(pv.v, tv.v) end, 6) as similarity
from pv join tv on pv.doc_id = tv.doc_id
""")
def j12_row_matrix(spark, sf_dir):
    """Every sub-text of a row against every theme of the same row."""
    rows = texts(spark, sf_dir, "source", "lang").select(
        "doc_id", embed.letter_profiles(text.split_trim(F.col("text"))).alias("pv"),
        embed.letter_profiles(F.array("source", "lang")).alias("tv"),
    )
    matrix = rows.select("doc_id", F.posexplode(embed.similarity_matrix(F.col("pv"), F.col("tv"))).alias("part", "cells"))
    return matrix.select("doc_id", "part", F.posexplode("cells").alias("theme", "s")).select(
        "doc_id", "part", "theme", F.round("s", 6).alias("similarity")
    )


@query("f19_length_weights", f"""
with p as (select doc_id, unnest(parts) as part from {PARTS}),
w as (select doc_id, length(part)::double / sum(length(part)) over (partition by doc_id) as w from p)
select doc_id, count(*) as n_parts, round(max(w), 8) as heaviest, round(sum(w), 6) as whole from w group by 1
""")
def f19_length_weights(spark, sf_dir):
    parts = texts(spark, sf_dir).select("doc_id", text.split_trim(F.col("text")).alias("parts"))
    weights = parts.where(F.size("parts") > 0).withColumn("w", vectors.length_weights(F.col("parts")))
    return weights.select(
        "doc_id", F.size("w").cast("long").alias("n_parts"), F.round(F.array_max("w"), 8).alias("heaviest"),
        F.round(F.aggregate("w", F.lit(0.0), lambda a, b: a + b), 6).alias("whole"),
    )


@query("f20_cosine", """
select vec_id, round(case when vec_id % 7 = 0 then 0
  else list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]) end, 6) as similarity from embeddings
""")
def f20_cosine(spark, sf_dir):
    vector = F.col("embedding")
    mirrored = F.when(F.col("vec_id") % 7 == 0, F.transform(vector, lambda x: x * 0)).otherwise(F.reverse(vector))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(vectors.cosine(vector, mirrored), 6).alias("similarity")
    )


CENTROIDS_SQL = """dims as (
  select label, unnest(embedding)::double as x, unnest(range(0, 64)) as i from embeddings
), means as (select label, i, avg(x) as m from dims group by 1, 2),
centroids as (select label, list(m order by i) as c from means group by 1)"""


def label_centroids(spark, sf_dir):
    return clusters.centroids_of(table(spark, sf_dir, "embeddings"), "embedding", "label")


@query("j12_cross_similarity", f"""
with {CENTROIDS_SQL}
select vec_id, c.label, round(list_cosine_similarity(embedding::double[], c), 6) as similarity from embeddings, centroids c
""")
def j12_cross_similarity(spark, sf_dir):
    packed = label_centroids(spark, sf_dir).agg(
        F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("a")
    ).scalar()
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("_c", packed)
    matrix = embed.similarity_matrix(F.array("embedding"), F.col("_c.centroid"))
    cells = F.arrays_zip(F.col("_c.label").alias("label"), F.get(matrix, F.lit(0)).alias("similarity"))
    return rows.select("vec_id", F.explode(cells).alias("r")).select(
        "vec_id", "r.label", F.round("r.similarity", 6).alias("similarity")
    )


@query("c6_nearest_centroid", f"""
with {CENTROIDS_SQL}
select vec_id, arg_min(c.label, (list_distance(embedding::double[], c), c.label)) as cluster,
       round(min(list_distance(embedding::double[], c)), 6) as distance
from embeddings, centroids c group by 1
""")
def c6_nearest_centroid(spark, sf_dir):
    centroids = label_centroids(spark, sf_dir).select(F.col("label").alias("cluster"), "centroid")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = clusters.nearest_centroid(rows, "embedding", centroids)
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def banded_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", F.floor((F.col("c_acctbal") + 1000) / 2200).cast("int").alias("band")
    )


BANDS_SQL = "(select c_custkey as id, c_acctbal as x, c_mktsegment, floor((c_acctbal + 1000) / 2200)::int as band from customer)"


def silhouette_sql(cluster: str) -> str:
    return f"""
  select avg(case when m = 1 then 0 else (b - a) / greatest(a, b) end) as s from (
    select id, max(m) filter (own) as m, max(d / (m - 1)) filter (own and m > 1) as a, min(d / m) filter (not own) as b from (
      select p.id, p.{cluster} = q.{cluster} as own, q.{cluster}, count(*) as m, sum(abs(p.x - q.x)) as d
      from {BANDS_SQL} p, {BANDS_SQL} q group by p.id, p.{cluster}, q.{cluster}
    ) group by id
  )"""


@query("c8_silhouette_1d", f"""
select 'band' as clustering, round(s, 6) as silhouette from ({silhouette_sql('band')})
union all select 'segment', round(s, 6) from ({silhouette_sql('c_mktsegment')})
""")
def c8_silhouette_1d(spark, sf_dir):
    customers = banded_customers(spark, sf_dir)
    parts = [
        clusters.silhouette_1d(customers, "c_acctbal", column).select(
            F.lit(name).alias("clustering"), F.round("silhouette", 6).alias("silhouette")
        )
        for name, column in (("band", "band"), ("segment", "c_mktsegment"))
    ]
    return parts[0].unionByName(parts[1])


@query("c9_davies_bouldin", f"""
with {CENTROIDS_SQL},
spread as (
  select e.label, avg(list_distance(e.embedding::double[], c.c)) as s, any_value(c.c) as c
  from embeddings e join centroids c on e.label = c.label group by 1
)
select round(avg(w), 6) as davies_bouldin from (
  select a.label, max((a.s + b.s) / list_distance(a.c, b.c)) as w from spread a join spread b on a.label <> b.label group by 1
)
""")
def c9_davies_bouldin(spark, sf_dir):
    out = clusters.davies_bouldin(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("c10_calinski_harabasz", f"""
with {CENTROIDS_SQL}, grand as (select i, avg(x) as g from dims group by 1),
sizes as (select label, count(*) as n from embeddings group by 1),
b as (select sum(n * (m - g) * (m - g)) as b from means join grand on means.i = grand.i join sizes on means.label = sizes.label),
w as (select sum((x - m) * (x - m)) as w from dims join means on dims.label = means.label and dims.i = means.i),
k as (select count(*) as k, sum(n) as n from sizes)
select round((b / (k - 1)) / (w / (n - k)), 6) as calinski_harabasz from b, w, k
""")
def c10_calinski_harabasz(spark, sf_dir):
    out = clusters.calinski_harabasz(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


def ari_sql(source: str, a: str, b: str) -> str:
    return f"""(
  with cells as (select {a} as a, {b} as b, count(*)::double as n from {source} group by 1, 2),
  t as (select sum(n * (n - 1) / 2) as s, sum(n) * (sum(n) - 1) / 2 as p from cells),
  l as (select sum(n * (n - 1) / 2) as l from (select sum(n) as n from cells group by a)),
  r as (select sum(n * (n - 1) / 2) as r from (select sum(n) as n from cells group by b))
  select (s - l * r / p) / ((l + r) / 2 - l * r / p) as v from t, l, r)"""


def nmi_sql(source: str, a: str, b: str) -> str:
    return f"""(
  with cells as (select {a} as a, {b} as b, count(*)::double as n from {source} group by 1, 2),
  t as (select sum(n) as t from cells),
  hab as (select -sum(n / t * ln(n / t)) as h from cells, t),
  ha as (select -sum(n / t * ln(n / t)) as h from (select sum(n) as n from cells group by a), t),
  hb as (select -sum(n / t * ln(n / t)) as h from (select sum(n) as n from cells group by b), t)
  select (ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2) as v from ha, hb, hab)"""


@query("c11_ari", f"""
select 'orders' as source, round(v, 10) as ari from {ari_sql('orders', 'o_orderstatus', 'o_orderpriority')}
union all select 'part', round(v, 10) from {ari_sql('part', 'p_type', 'p_brand')}
""")
def c11_ari(spark, sf_dir):
    orders = clusters.adjusted_rand(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    part = clusters.adjusted_rand(table(spark, sf_dir, "part"), "p_type", "p_brand")
    return orders.withColumn("source", F.lit("orders")).unionByName(part.withColumn("source", F.lit("part"))).withColumn(
        "ari", F.round("ari", 10)
    )


@query("c12_nmi", f"""
select 'orders' as source, round(v, 10) as nmi from {nmi_sql('orders', 'o_orderstatus', 'o_orderpriority')}
union all select 'part', round(v, 10) from {nmi_sql('part', 'p_type', 'p_brand')}
""")
def c12_nmi(spark, sf_dir):
    orders = clusters.normalized_mutual_info(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    part = clusters.normalized_mutual_info(table(spark, sf_dir, "part"), "p_type", "p_brand")
    return orders.withColumn("source", F.lit("orders")).unionByName(part.withColumn("source", F.lit("part"))).withColumn(
        "nmi", F.round("nmi", 10)
    )


@query("c13_metric_row", f"""
with b as (select * from {BANDS_SQL}), m as (select band, avg(x) as m, count(*) as n from b group by 1),
spread as (select b.band, avg(abs(x - m)) as s, any_value(m) as m from b join m on b.band = m.band group by 1),
db as (select avg(w) as v from (select p.band, max((p.s + q.s) / abs(p.m - q.m)) as w from spread p join spread q on p.band <> q.band group by 1)),
ch as (
  select (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / ((select sum((x - m) * (x - m)) from b join m on b.band = m.band) / (sum(n) - count(*))) as v
  from m, (select avg(x) as g from b)
)
select round(s, 6) as silhouette, round(db.v, 6) as davies_bouldin, round(ch.v, 4) as calinski_harabasz,
       round(ari.v, 8) as ari, round(nmi.v, 8) as nmi
from ({silhouette_sql('band')}), db, ch, {ari_sql('b', 'c_mktsegment', 'band')} ari, {nmi_sql('b', 'c_mktsegment', 'band')} nmi
""")
def c13_metric_row(spark, sf_dir):
    row = clusters.metric_row(banded_customers(spark, sf_dir), "c_acctbal", "band", "c_mktsegment", 5)
    return row.select(
        F.round("silhouette", 6).alias("silhouette"), F.round("davies_bouldin", 6).alias("davies_bouldin"),
        F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("ari", 8).alias("ari"),
        F.round("nmi", 8).alias("nmi"),
    )


def embedding_vectors(spark, sf_dir):
    return clusters.as_vector(table(spark, sf_dir, "embeddings"), "embedding")


@query("c5_kmeans")
def c5_kmeans(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings")
    run = kmeans.kmeans_runs(data, "embedding", [5])[5]
    return run.transform(data, "embedding").select("vec_id", "cluster")


@query("c5_assignment_is_nearest", "select vec_id, true as nearest from embeddings")
def c5_assignment_is_nearest(spark, sf_dir):
    """Whether k-means puts each row with the centre that the distance query finds."""
    data = embedding_vectors(spark, sf_dir)
    model = clusters.kmeans_best(data, 5, starts=1)
    centres = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>"
    )
    rows = model.transform(data).select("vec_id", F.col("cluster").alias("said"), F.col("embedding").cast("array<double>").alias("v"))
    found = clusters.nearest_centroid(rows, "v", centres)
    return found.select("vec_id", (F.col("said") == F.col("cluster")).alias("nearest"))


@query("c7_k_sweep")
def c7_k_sweep(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_acctbal")
    best, scores, _ = clusters.k_sweep(customers, "c_acctbal")
    return scores.withColumn("best", F.col("k") == best)


@query("c7_fit_is_at_rest", "select unnest([5, 10, 20]) as k, true as all_filled, true as centres_are_means, true as cost_is_their_spread")
def c7_fit_is_at_rest(spark, sf_dir):
    """Whether every cluster has rows, its centre is their mean and the cost is their spread, up to the tolerance."""
    values = table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("x"))
    runs = kmeans.kmeans_runs(values, "x", [5, 10, 20], tolerance=0.0)
    centres = spark.createDataFrame(
        [(k, i, float(c[0]), run.cost) for k, run in runs.items() for i, c in enumerate(run.values)], "k int, c int, centre double, cost double"
    )
    placed = values.select("x", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), run.place(F.col("x")).alias("c")) for k, run in runs.items()])).alias("r"))
    means = placed.groupBy("r.k", "r.c").agg(
        F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("spread")
    )
    return centres.join(means, ["k", "c"], "left").groupBy("k").agg(
        F.bool_and(F.col("mean").isNotNull()).alias("all_filled"),
        F.coalesce(F.bool_and(F.abs(F.col("centre") - F.col("mean")) < 1e-6), F.lit(False)).alias("centres_are_means"),
        (F.abs(F.sum("spread") - F.first("cost")) < 1e-6 * F.first("cost")).alias("cost_is_their_spread"),
    )


@query("c15_project2d")
def c15_project2d(spark, sf_dir):
    return clusters.project_2d(embedding_vectors(spark, sf_dir), "features").select("vec_id", "x", "y")
