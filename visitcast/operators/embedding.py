"""Patient vectors from disease histories, as of each day.

A patient's vector is the mean of the vectors of the codes seen so far, kept as a running
state: one row for each day on which a new code was seen, usable from the day after.
A visit of day t takes the last state before t, so nothing from t on enters it. The code
vectors themselves are fitted on visits before a day of their own; where no visit at all
may look ahead, vectors begin on that day (`start`).
"""

from __future__ import annotations

from datetime import date

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 16


def first_visits(visits: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, disease, first_date; rows without patient, disease or date and visits from `as_of` on are left out."""
    known = visits.filter(F.col("patient_id").isNotNull() & F.col("disease").isNotNull() & F.col("visit_date").isNotNull())
    if as_of is not None:
        known = known.filter(F.col("visit_date") < F.lit(as_of))
    return known.groupBy("patient_id", "disease").agg(F.min("visit_date").alias("first_date"))


def patient_sentences(visits: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, sentence: the patient's diseases by first visit, then code; visits from `as_of` on are left out."""
    return first_visits(visits, as_of).groupBy("patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_date", "disease"))), lambda s: s["disease"]).alias("sentence"))


def fit_word2vec(sentences: DataFrame, size: int = SIZE, seed: int = 1, per_task: int = 20_000) -> Word2VecModel:
    """Fitted on about `per_task` sentences a task, the tasks' vectors averaged; every code counts, however rare.

    Same seed and same partitions, same vectors up to the order in which they are summed.
    """
    partitions = max(1, -(-sentences.count() // per_task))
    return Word2Vec(vectorSize=size, minCount=1, seed=seed, numPartitions=partitions, inputCol="sentence", outputCol="vector").fit(sentences)


def patient_vectors(model: Word2VecModel, sentences: DataFrame) -> DataFrame:
    """patient_id, vector: the mean of the sentence's codes."""
    return model.transform(sentences).select("patient_id", vector_to_array("vector").alias("vector"))


def code_vectors(model: Word2VecModel) -> DataFrame:
    """disease, vector: one row a code."""
    return model.getVectors().select(F.col("word").alias("disease"), vector_to_array("vector").alias("vector"))


def _each(vector: str, size: int, f) -> list[Column]:
    return [f(F.get(vector, F.lit(i))) for i in range(size)]


def patient_history(visits: DataFrame, codes: DataFrame, size: int = SIZE) -> DataFrame:
    """patient_id, since, vector, n_codes: the running mean over the patient's codes with a vector; usable from `since` on.

    `codes` holds disease and vector (`size` numbers). A day's codes enter on the day after.
    """
    daily = first_visits(visits).join(codes, "disease").groupBy("patient_id", "first_date").agg(F.count("*").alias("_n"), F.array(*_each("vector", size, F.sum)).alias("_sums"))
    so_far = Window.partitionBy("patient_id").orderBy("first_date").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("_n").over(so_far)
    vector = F.array(*_each("_sums", size, lambda x: F.sum(x).over(so_far) / n))
    return daily.select("patient_id", F.date_add("first_date", 1).alias("since"), vector.alias("vector"), n.alias("n_codes"))


def vectors_as_of(visits: DataFrame, history: DataFrame, start: date | Column | None = None) -> DataFrame:
    """patient_id, visit_date, vector, n_codes for each patient and day with a visit: the last state usable on that day, null before any.

    States and days of a patient meet in one window, bounded by the days and codes of one patient. With `start`, earlier days get none.
    """
    asked = visits.select("patient_id", F.col("visit_date").alias("_day")).filter(F.col("patient_id").isNotNull() & F.col("_day").isNotNull()).distinct().select("*", F.lit(1).alias("_kind"), F.lit(None).cast(history.schema["vector"].dataType).alias("vector"), F.lit(None).cast("long").alias("n_codes"))
    states = history.select("patient_id", F.col("since").alias("_day"), F.lit(0).alias("_kind"), "vector", "n_codes")
    so_far = Window.partitionBy("patient_id").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    met = states.unionByName(asked).select("patient_id", F.col("_day").alias("visit_date"), "_kind", last("vector"), last("n_codes")).filter("_kind = 1").drop("_kind")
    if start is None:
        return met
    begun = F.col("visit_date") >= (start if isinstance(start, Column) else F.lit(start))
    return met.withColumns({c: F.when(begun, F.col(c)) for c in ("vector", "n_codes")})


def embedding_features(visits: DataFrame, vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """date, district, disease, embedding, embedded: the mean vector of the visits' patients, and how many of the visits have one.

    Groups in which no patient has a vector stay, with a null embedding. `vectors` holds a row for
    each patient, or for each patient and day (vectors_as_of).
    """
    on = [c for c in ("patient_id", "visit_date") if c in vectors.columns]
    joined = visits.join(vectors.select(*on, "vector"), on, "left")
    grouped = joined.groupBy(F.col("visit_date").alias("date"), "district", "disease").agg(F.count("vector").alias("embedded"), F.array(*_each("vector", size, F.avg)).alias("_mean"))
    return grouped.select("date", "district", "disease", F.when(F.col("embedded") > 0, F.col("_mean")).alias("embedding"), "embedded")
