"""Corpus models: word vectors and reduced embeddings from ``pyspark.ml``, topics from blocks of documents."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators.topics import corpus_topics, top_words

def word_vectors(
    docs: DataFrame,
    text: str = "text",
    size: int = 100,
    window: int = 5,
    min_count: int = 1,
    iterations: int = 1,
    partitions: int | None = None,
    seed: int = 42,
):
    """Skip-gram vectors over the sentences' words.

    ``min_count`` decides which words the model, and with it the driver, holds;
    without ``partitions`` as many tasks train as the session runs at a time.
    """
    lines = docs.select(F.explode(X.sentences(text)).alias("_s")).select(
        X.words("_s").alias("words")
    )
    return Word2Vec(
        vectorSize=size,
        windowSize=window,
        minCount=min_count,
        maxIter=iterations,
        numPartitions=partitions or docs.sparkSession.sparkContext.defaultParallelism,
        seed=seed,
        inputCol="words",
        outputCol="vector",
    ).fit(lines)


def similar_words(model, target: str, k: int = 10) -> DataFrame:
    """The ``k`` nearest words of a target by cosine."""
    return model.findSynonyms(target, k)


def topics(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    n_words: int = 5,
    stop=K.STOP_WORDS,
    min_df: int = 1,
    iterations: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Topics ``(topic, rank, word, weight)`` over the content words.

    The dictionary is every word and number that ``min_df`` texts hold, and
    every iteration sees the whole corpus; neither is held in one place
    (:func:`sentiloom.operators.topics.corpus_topics`).
    """
    model = corpus_topics(docs, key, text, k, iterations, stop=stop, min_df=min_df, seed=seed)
    return top_words(model.words, n_words)


def reduce_embeddings(
    df: DataFrame, vector: str = "embedding", k: int = 3, name: str = "reduced"
) -> DataFrame:
    """Centre the vectors, then project them on ``k`` principal components.

    Only the means and the covariance, sized by the dimension, reach the driver.
    """
    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data)
    centred = scaler.transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return (
        model.transform(centred)
        .withColumn(name, vector_to_array("_p"))
        .drop("_v", "_c", "_p", vector)
    )
