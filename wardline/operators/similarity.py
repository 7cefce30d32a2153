"""Vector similarity and text vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.plans.scale import top_k


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """Vector scaled to length 1, or null for a zero vector."""
    size = F.sqrt(dot(vector, vector))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size))


def related(
    targets: DataFrame,
    pool: DataFrame,
    id_col: str,
    vector: str,
    k: int = 5,
    min_similarity: float = 0.75,
    day: str | None = None,
    days: int = 30,
    same: Sequence[str] = (),
) -> DataFrame:
    """For each target the ``k`` most similar pool rows at or above ``min_similarity``.

    A target never meets itself. ``same`` columns (department, encoder), at least one, must be equal; with ``day``
    the pool row may be at most ``days`` older than the target. Every target is compared with its
    whole block, so pass the incidents asked about as targets: the work is targets times block.
    Vectors are scaled once on each side, and only the best ``k`` per target leave a partition.
    """
    if not same:
        raise ValueError("name at least one column that must be equal; without it every pair would be compared")
    keep = [id_col, *same, *([day] if day else [])]
    left = targets.select(*[F.col(c).alias(f"_t_{c}") for c in keep], unit(F.col(vector)).alias("_t_vec"))
    right = pool.select(*keep, unit(F.col(vector)).alias("_vec"))
    on = F.col(id_col) != F.col(f"_t_{id_col}")
    for column in same:
        on = on & (F.col(column) == F.col(f"_t_{column}"))
    if day:
        on = on & (F.col(day) >= F.date_sub(F.col(f"_t_{day}"), days))
    pairs = right.join(left, on).select(
        F.col(f"_t_{id_col}").alias("target_id"), F.col(id_col).alias("related_id"),
        dot(F.col("_vec"), F.col("_t_vec")).alias("similarity"),
    )
    near = pairs.filter(F.col("similarity") >= min_similarity)
    return top_k(near, k, [F.col("similarity").desc(), F.col("related_id").asc()], ["target_id"])


def fit_vectors(df: DataFrame, text: str, features: int = 4096) -> PipelineModel:
    """Model of length-1 TF-IDF weights of hashed words, fitted on all rows of ``df``."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    weights = IDF(inputCol="_counts", outputCol="_weights", minDocFreq=1)
    scaled = Normalizer(inputCol="_weights", outputCol="_scaled")
    return Pipeline(stages=[words, counts, weights, scaled]).fit(df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")))


def kept_vectors(df: DataFrame, text: str, folder: str, model: str, version: str, features: int = 4096) -> PipelineModel:
    """The model stored under (model, version); where there is none yet it is fitted on ``df`` and stored.

    One version is one model, so a text has the same vector in every batch. A new version is fitted anew.
    """
    path = f"{folder}/{model}/{version}"
    try:
        return PipelineModel.load(path)
    except Exception as missing:  # the file system decides which error a missing folder is
        if "does not exist" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
            raise
    fitted = fit_vectors(df, text, features)
    fitted.write().overwrite().save(path)
    return fitted


def hashed_vectors(df: DataFrame, text: str, features: int = 4096, fitted: PipelineModel | None = None) -> DataFrame:
    """Adds ``vector``: length-1 TF-IDF weights of hashed words, by a fitted model or by one fitted on these rows."""
    base = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = (fitted or fit_vectors(df, text, features)).transform(base)
    return out.withColumn("vector", vector_to_array("_scaled", "float32")).drop(
        "_text", "_words", "_counts", "_weights", "_scaled"
    )


def embed(
    df: DataFrame,
    id_col: str,
    text: str,
    model: str,
    version: str,
    done: DataFrame | None = None,
    encoder: Callable | None = None,
    features: int = 4096,
    folder: str | None = None,
) -> DataFrame:
    """(id, vector, model, version) for the narratives without a vector of this model and version.

    ``encoder`` is a pandas UDF over text (an iterator UDF loads its model once per task); the
    default is hashed TF-IDF. With ``folder`` its weights are fitted once, on all rows of ``df`` at the first batch of a
    version, and kept there, so vectors of later batches compare with earlier ones; without it they are fitted on ``df``.
    """
    todo = df.select(id_col, text)
    if done is not None:
        have = done.filter((F.col("model") == model) & (F.col("version") == version)).select(id_col)
        todo = todo.join(have, id_col, "left_anti")
    if encoder is None:
        fitted = kept_vectors(df, text, folder, model, version, features) if folder else fit_vectors(df, text, features)
        out = hashed_vectors(todo, text, features, fitted)
    else:
        out = todo.withColumn("vector", encoder(F.col(text)))
    return out.select(id_col, "vector", F.lit(model).alias("model"), F.lit(version).alias("version"))
