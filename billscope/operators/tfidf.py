"""TF-IDF weights as a long table (document, term, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billscope.operators.keyed import attach

# Fixed value: a token is two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Characters of the texts whose terms one task counts, on average.
DEALT = 1 << 24


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stop_words(language: str = "portuguese") -> list[str]:
    """Spark's built-in stop-word list of a language."""
    return StopWordsRemover.loadDefaultStopWords(language)


def without_words(df: DataFrame, column: str, words: Sequence[str] | DataFrame) -> DataFrame:
    """Drop the rows whose token is a stop word (short list or one-column table)."""
    if isinstance(words, DataFrame):
        side = words.select(F.col(words.columns[0]).alias("_w")).distinct()
        return df.join(side, df[column] == side["_w"], "left_anti")
    return df.where(~F.col(column).isin(*words)) if words else df


def term_counts(
    df: DataFrame, doc: str, text: str, words: Sequence[str] | DataFrame = ()
) -> DataFrame:
    """Occurrences of each term in each document."""
    terms = df.select(doc, F.explode(tokens(F.col(text))).alias("term"))
    return without_words(terms, "term", words).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def dealt(df: DataFrame, text: str) -> int:
    """Partitions for texts whose terms are counted."""
    chars = df.agg(F.sum(F.length(text)).alias("n")).first().n or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // DEALT))


def tfidf(
    df: DataFrame,
    doc: str,
    text: str,
    words: Sequence[str] | DataFrame = (),
    min_df: int = 3,
    max_df: float = 0.8,
) -> DataFrame:
    """tf * (ln((1+n)/(1+df)) + 1), each document scaled to length one.

    Terms in fewer than ``min_df`` documents or more than ``max_df`` of them are left
    out. Terms in more than a hundredth of the documents are at most a hundred times the
    terms of one document; their idf comes by broadcast. The long tail takes a shuffle
    join, so no term gathers its rows in one task. Dealing the documents out by their key
    first moves each text once; counting its terms then needs no shuffle of its own. There are
    at least as many partitions as ``DEALT`` takes, so what a task counts does not grow with the corpus.
    """
    counts = term_counts(df.repartition(dealt(df, text), doc), doc, text, words)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("_rows"))
    kept = frequency.withColumn("_n", n).where(
        (F.col("_rows") >= min_df) & (F.col("_rows") <= F.lit(float(max_df)) * F.col("_n"))
    )
    kept = kept.select("term", "_rows", (F.col("_n") / 100).alias("_common"), (F.log((F.col("_n") + 1.0) / (F.col("_rows") + 1.0)) + 1.0).alias("idf"))
    common = F.col("_rows") > F.col("_common")
    weighed = attach(counts, ["term"], kept, check=False, hot_when=common).where(F.col("idf").isNotNull()).drop("_common")
    weighed = weighed.withColumn("_w", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighed.select(doc, "term", (F.col("_w") / size).alias("weight"))


def tfidf_vectors(
    df: DataFrame, text: str, output: str = "features", words: Sequence[str] = (),
    min_df: int = 3, max_df: float = 0.8,
) -> DataFrame:
    """The same weights as sparse vectors, for MLlib estimators.

    The vocabulary is all terms that the document limits leave, as in ``tfidf``; MLlib's model
    holds it on the driver.
    """
    remover = StopWordsRemover(inputCol="_all", outputCol="_tokens", caseSensitive=True, stopWords=list(words))
    cut = remover.transform(df.withColumn("_all", tokens(F.col(text)))).drop("_all")
    counted = CountVectorizer(
        inputCol="_tokens", outputCol="_tf", minDF=float(min_df), vocabSize=(1 << 31) - 1,
        # MLlib reads 1.0 and more as a number of documents, less as a share of them
        maxDF=float(max_df) if max_df < 1 else 2.0**62,
    ).fit(cut).transform(cut)
    idf = IDF(inputCol="_tf", outputCol="_x").fit(counted)
    scale = Vectors.dense(idf.idf.toArray() + 1.0)
    scaled = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_scaled").transform(counted)
    return Normalizer(p=2.0, inputCol="_scaled", outputCol=output).transform(scaled).drop("_tokens", "_tf", "_scaled")
