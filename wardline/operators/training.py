"""Training sets, encoding, model fitting, scoring and contribution roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, NGram, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent, ratio, risk_band, rounded
from wardline.functions.text import compose_text, is_sparse, strip
from wardline.operators.evaluation import ranking_metrics
from wardline.operators.sampling import split
from wardline.plans.scale import top_k, work_folder
from wardline.rules.quality import PLACEHOLDERS

# Fixed values.
MISSING = "_MISSING_"
MIN_ROWS = 20
MIN_POSITIVE = 5
TEXT_FACTOR = "Narrative content"
MIN_CONTRIBUTION = 0.001
SOURCES = ("SYNTHETIC", "HUMAN_APPROVED_SYNTHETIC", "MIXED_SYNTHETIC")


def usable_narrative(narrative: Column, quality: Column) -> Column:
    """Not critical, not empty, no placeholder, and at least one letter or digit."""
    text = F.lower(strip(F.coalesce(narrative, F.lit(""))))
    return (
        F.coalesce(quality != "CRITICAL", F.lit(True)) & (text != "") & ~text.isin(*PLACEHOLDERS)
        & ~text.rlike(r"^(?:desc|test|sample|incident)\s*\d+$") & text.rlike(r"[\p{L}\p{N}]")
    )


def training_roles(df: DataFrame, source: str) -> DataFrame:
    """Adds ``train_source``, ``label`` and, for rows left out, the reason ``excluded``.

    Human decisions come before dataset labels; simulated reviews and insufficient information never
    give a label. ``df`` has is_synthetic, is_simulated, human_decision, human_label, label_source,
    raw_label, quality_status and narrative.
    """
    if source not in SOURCES:
        raise ValueError(f"training source must be one of {SOURCES}")
    real = F.coalesce("is_synthetic", F.lit(False)) & ~F.coalesce("is_simulated", F.lit(False))
    dec = F.coalesce("human_decision", F.lit(""))
    approved = (F.coalesce("label_source", F.lit("")) == "human_approved_synthetic") & F.col("human_label").isNotNull()
    good = usable_narrative(F.col("narrative"), F.col("quality_status"))
    raw = F.lower(F.col("raw_label").cast("string"))
    decided, unsure = dec.isin("PSIF", "NOT_PSIF"), dec == "INSUFFICIENT_INFORMATION"
    with_human, with_synthetic = source != "SYNTHETIC", source != "HUMAN_APPROVED_SYNTHETIC"
    human = F.lit(with_human) & real & (decided | unsure | approved)
    synthetic = F.lit(with_synthetic) & real & ~unsure & ~decided
    human_label = F.when(decided, dec == "PSIF").otherwise(F.col("human_label"))
    raw_label = F.when(raw.isin("1", "true"), F.lit(True)).when(raw.isin("0", "false"), F.lit(False)).otherwise(
        F.when(approved, F.col("human_label"))
    )
    train_source = (
        F.when(human & ~unsure & good, "human_approved_synthetic")
        .when(synthetic & raw_label.isNotNull() & good, "synthetic")
    )
    df = df.withColumn("train_source", train_source)
    label = F.when(F.col("train_source") == "synthetic", raw_label).when(F.col("train_source").isNotNull(), human_label)
    reason = F.when(
        F.col("train_source").isNull(),
        F.when(human & unsure, "INSUFFICIENT_INFORMATION")
        .when((human & ~unsure & ~good) | (synthetic & raw_label.isNotNull() & ~good), "CRITICAL_QUALITY")
        .when(synthetic, "UNKNOWN_LABEL"),
    )
    return df.withColumns({"label": label, "excluded": reason})


def training_set(
    df: DataFrame, source: str, limit: int | None = None, order: Sequence[str] = ("incident_id",)
) -> DataFrame:
    """Eligible rows with label and source; with ``limit`` human rows first, then in ``order``."""
    rows = training_roles(df, source).filter(F.col("train_source").isNotNull()).drop("excluded")
    if limit is None:
        return rows
    first = F.when(F.col("train_source") == "synthetic", 1).otherwise(0)
    return rows.orderBy(first, *order).limit(limit)


def composition(roles: DataFrame) -> DataFrame:
    """One row: eligible by source and label, excluded by reason."""
    src = F.col("train_source")
    return roles.agg(
        F.count_if(src.isNotNull()).alias("eligible"),
        F.count_if(src == "human_approved_synthetic").alias("human_approved"),
        F.count_if(src == "synthetic").alias("synthetic"),
        F.count_if("label").alias("positive"), F.count_if(~F.col("label")).alias("negative"),
        *[F.count_if(F.col("excluded") == r).alias(f"excluded_{r.lower()}")
          for r in ("INSUFFICIENT_INFORMATION", "CRITICAL_QUALITY", "UNKNOWN_LABEL")],
    )


def source_overview(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(source, rows, eligible) for the synthetic and the human-approved source, in one pass."""
    base = (
        F.coalesce("is_synthetic", F.lit(False)) & ~F.coalesce("is_simulated", F.lit(False))
        & (F.coalesce("human_decision", F.lit("")) != "INSUFFICIENT_INFORMATION")
        & (F.coalesce("quality_status", F.lit("")) != "CRITICAL") & (F.coalesce("narrative", F.lit("")) != "")
    )
    human = F.coalesce("human_decision", F.lit("")).isin("PSIF", "NOT_PSIF") | (
        (F.coalesce("label_source", F.lit("")) == "human_approved_synthetic") & F.col("human_label").isNotNull()
    )
    counts = df.agg(
        F.count_if(base & F.col("raw_label").isNotNull()).alias("s"), F.count_if(base & human).alias("h")
    )
    long = counts.select(F.inline(F.array(
        F.struct(F.lit("SYNTHETIC").alias("source"), F.col("s").alias("rows")),
        F.struct(F.lit("HUMAN_APPROVED_SYNTHETIC").alias("source"), F.col("h").alias("rows")),
    )))
    return long.withColumn("eligible", F.col("rows") >= min_rows)


def label_audit(df: DataFrame, label: str = "effective_label") -> DataFrame:
    """One row: rows by provenance, eligible positives and negatives, class ratio, and what forbids training."""
    syn, sim = F.coalesce("is_synthetic", F.lit(False)), F.coalesce("is_simulated", F.lit(False))
    dec = F.coalesce("human_decision", F.lit(""))
    eligible = syn & ~sim & (dec != "INSUFFICIENT_INFORMATION")
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(syn & ~sim & (dec == "PSIF")).alias("human_psif"),
        F.count_if(syn & ~sim & (dec == "NOT_PSIF")).alias("human_not_psif"),
        F.count_if(~sim & (dec == "INSUFFICIENT_INFORMATION")).alias("human_insufficient"),
        F.count_if(sim).alias("simulated"),
        F.count_if(F.col("label_source") == "real_external").alias("real_external"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & F.col(label)).alias("positive"),
        F.count_if(eligible & ~F.col(label)).alias("negative"),
    )
    problem = (
        F.when(F.col("eligible") < MIN_ROWS, "TOO_FEW_ROWS").when(F.col("positive") == 0, "NO_POSITIVES")
        .when(F.col("negative") == 0, "NO_NEGATIVES").when(F.col("positive") < MIN_POSITIVE, "TOO_FEW_POSITIVES")
    )
    return out.select(
        "*", percent(F.col("positive"), F.col("eligible"), 2).alias("positive_pct"),
        ratio(F.col("negative"), F.col("positive"), 2).alias("negative_per_positive"), problem.alias("problem"),
    )


def require_trainable(audit: DataFrame) -> None:
    """Stop before any fitting when the audit names a problem."""
    problem = audit.select("problem").first()[0]
    if problem:
        raise ValueError(f"training data not usable: {problem}")


def training_rows(df: DataFrame, label: str, keep: Sequence[str], texts: Sequence[str], composite: str) -> DataFrame:
    """Labelled rows with a narrative (stored, else composed) and a 0/1 label."""
    narrative = F.coalesce(F.nullif(F.col(composite), F.lit("")), compose_text(list(texts)))
    return df.filter(F.col(label).isNotNull()).select(
        *keep, narrative.alias("narrative"), F.col(label).cast("int").alias("label")
    )


def encoder(flags: Sequence[str], categories: Sequence[str], output: str = "structured") -> Pipeline:
    """Flags as 0/1, categories one-hot with a missing value of their own; unseen ones become zeros.

    Expects the columns of ``encode_inputs``.
    """
    index = StringIndexer(
        inputCols=[f"_c_{c}" for c in categories], outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    hot = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories], dropLast=True
    )
    # the indexer puts unseen values last, and the last slot is the one dropped
    parts = VectorAssembler(inputCols=[*[f"_f_{f}" for f in flags], *[f"_h_{c}" for c in categories]], outputCol=output)
    return Pipeline(stages=[index, hot, parts])


def encode_inputs(df: DataFrame, flags: Sequence[str], categories: Sequence[str]) -> DataFrame:
    return df.withColumns({
        **{f"_f_{f}": F.coalesce(F.col(f), F.lit(False)).cast("double") for f in flags},
        **{f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categories},
    })


def text_stages(text: str, output: str = "text_features", features: int = 4096, bigrams: bool = True) -> list:
    """Hashed TF-IDF of words and word pairs."""
    words = RegexTokenizer(inputCol=text, outputCol=f"_{output}_w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2)
    one = HashingTF(inputCol=f"_{output}_w", outputCol=f"_{output}_1", numFeatures=features)
    idf_one = IDF(inputCol=f"_{output}_1", outputCol=f"_{output}_i1")
    stages, parts = [words, one, idf_one], [f"_{output}_i1"]
    if bigrams:
        pairs = NGram(n=2, inputCol=f"_{output}_w", outputCol=f"_{output}_p")
        two = HashingTF(inputCol=f"_{output}_p", outputCol=f"_{output}_2", numFeatures=features)
        stages += [pairs, two, IDF(inputCol=f"_{output}_2", outputCol=f"_{output}_i2")]
        parts.append(f"_{output}_i2")
    return [*stages, VectorAssembler(inputCols=parts, outputCol=output)]


def class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: negatives per positive for positives, 1 for negatives, from these rows only."""
    share = train.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("w")).scalar()
    return train.withColumn("weight", F.when(F.col(label) == 1, share).otherwise(F.lit(1.0)))


def fold(df: DataFrame, id_col: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0 … folds-1 from a hash of the id."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int"))


def probability(column: str = "probability") -> Column:
    return vector_to_array(column).getItem(1)


def train_boosted(
    df: DataFrame,
    features: str,
    depths: Sequence[int] = (3, 5),
    steps: Sequence[float] = (0.05, 0.1),
    trees: Sequence[int] = (20,),
    folds: int = 5,
    seed: int = 42,
):
    """Boosted trees with grid search on F2 over the given folds.

    ``df`` has ``label``, ``weight`` and ``fold``. Returns (model on all rows, out-of-fold scores,
    chosen parameters). The rows are written to the shared folder, so what made them runs once, and the out-of-fold
    scores come from the models that the search has fitted without each fold.
    """
    folder = work_folder(df.sparkSession, "boosted")
    df.write.parquet(folder)
    df = df.sparkSession.read.parquet(folder)
    base = GBTClassifier(featuresCol=features, labelCol="label", weightCol="weight", seed=seed)
    grid = ParamGridBuilder().addGrid(base.maxDepth, list(depths)).addGrid(base.stepSize, list(steps)).addGrid(
        base.maxIter, list(trees)
    ).build()
    f2 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0, beta=2.0)
    search = CrossValidator(
        estimator=base, estimatorParamMaps=grid, evaluator=f2, numFolds=folds, foldCol="fold", parallelism=4, seed=seed,
        collectSubModels=True,
    ).fit(df)
    best = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
    chosen = {p.name: v for p, v in grid[best].items()}
    held_out = None
    for k in range(folds):
        scored = search.subModels[k][best].transform(df.filter(F.col("fold") == k)).withColumn("oof_score", probability())
        scored = scored.drop("rawPrediction", "probability", "prediction")
        held_out = scored if held_out is None else held_out.unionByName(scored)
    return search.bestModel, held_out, chosen


def score(
    df: DataFrame, model: PipelineModel, id_col: str, text: str, threshold: float = 0.5
) -> DataFrame:
    """(id, score, predicted, risk_level, sparse) from a fitted pipeline."""
    out = model.transform(df).withColumn("score", probability())
    return out.select(
        id_col, "score", (F.col("score") >= threshold).alias("predicted"), risk_band(F.col("score")).alias("risk_level"),
        is_sparse(text).alias("sparse"),
    )


def rollup_contributions(
    df: DataFrame, id_col: str, feature: str, contribution: str, active: str, text_prefix: str = "text_", k: int = 5
) -> DataFrame:
    """(id, field, contribution, rank, direction): one-hot parts summed per field, text parts to one factor.

    ``df`` is long: one row per feature, named ``field=category`` for one-hot parts; ``active`` tells
    whether the feature holds for the report. Fields whose active category is missing and tiny
    contributions are left out; the ``k`` largest by magnitude are kept.
    """
    name = F.col(feature)
    is_text = name.startswith(text_prefix)
    field = F.when(is_text, TEXT_FACTOR).otherwise(F.substring_index(name, "=", 1))
    category = F.when(F.col(active) & name.contains("="), F.substring_index(name, "=", -1))
    sums = df.groupBy(id_col, field.alias("field")).agg(
        F.sum(contribution).alias("contribution"), F.max(category).alias("category"),
        F.bool_or(F.col(active) | is_text).alias("shown"),
    )
    kept = sums.filter(
        F.col("shown") & (F.coalesce("category", F.lit("")) != MISSING) & (F.abs("contribution") >= MIN_CONTRIBUTION)
    )
    best = top_k(kept, k, [F.abs("contribution").desc(), F.col("field").asc()], [id_col])
    return best.select(
        id_col, "field", "category", "contribution", "rank",
        F.when(F.col("contribution") > 0, "positive").otherwise("negative").alias("direction"),
    )


def snapshot(rows: DataFrame, id_col: str, label: str, source: str) -> DataFrame:
    """Manifest: one line per training row with its own SHA-256."""
    line = F.concat_ws(":", F.col(id_col).cast("string"), F.col(label).cast("int").cast("string"), F.col(source))
    return rows.select(
        F.col(id_col).alias("incident_id"), F.col(label).cast("int").alias("target"), F.col(source).alias("label_source"),
        F.sha2(line, 256).alias("digest"),
    )


def snapshot_hash(manifest: DataFrame) -> DataFrame:
    """One row: rows, positives and a content hash that needs no order.

    The 256-bit row digests are added up in four parts and the sums hashed, so any partitioning gives
    the same value and no task sees all rows.
    """
    lanes = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = manifest.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target") == 1).alias("positive"),
        *[F.sum(lane).alias(f"_{i}") for i, lane in enumerate(lanes)],
    )
    parts = [F.col("rows").cast("string"), *[F.col(f"_{i}").cast("decimal(38,0)").cast("string") for i in range(4)]]
    return sums.select("rows", "positive", F.sha2(F.concat_ws("|", *parts), 256).alias("dataset_hash"))


def hash_tree(manifest: DataFrame, digits: int = 4) -> DataFrame:
    """(level, bucket, rows, digest): a tree of SHA-256 digests over a manifest, from its buckets up to the root.

    A row's bucket is the first ``digits`` hex digits of the hash of its id; a bucket's digest covers the sorted digests
    of its rows, a node's those of its up to 16 children in order. Two snapshots made with the same ``digits`` are equal
    where their digests are. A task gathers the rows of one bucket, so let ``16 ** digits`` grow with the rows: 4
    serves a billion. Repeated rows count as often as they occur. An empty manifest gives no rows.
    """
    text = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["digest"]), "")
    leaves = manifest.select(_bucket(digits).alias("bucket"), "digest").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sha2(text(F.struct("digest")), 256).alias("digest")
    )
    level = leaves.withColumn("level", F.lit(digits))
    out = level
    for depth in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("bucket", 1, depth).alias("_up")).agg(
            F.sum("rows").alias("rows"), F.sha2(text(F.struct("bucket", "digest")), 256).alias("digest")
        ).select(F.col("_up").alias("bucket"), "rows", "digest", F.lit(depth).alias("level"))
        out = out.unionByName(level)
    return out.select("level", "bucket", "rows", "digest")


def _bucket(digits: int) -> Column:
    return F.substring(F.sha2(F.col("incident_id").cast("string"), 256), 1, digits)


def changed_rows(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, digits: int = 4) -> DataFrame:
    """(incident_id, change): rows added, removed or changed between two manifests, one row per id.

    The stored trees name the buckets that differ; only their rows are compared.
    """
    pick = lambda tree, name: tree.filter(F.col("level") == digits).select("bucket", F.col("digest").alias(name))
    differ = pick(old_tree, "a").join(pick(new_tree, "b"), "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")

    def rows(manifest: DataFrame, name: str) -> DataFrame:
        near = manifest.withColumn("bucket", _bucket(digits)).join(differ, "bucket", "left_semi")
        return near.groupBy("incident_id").agg(F.array_sort(F.collect_list("digest")).alias(name))

    both = rows(old, "a").join(rows(new, "b"), "incident_id", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select("incident_id", change.alias("change"))


def baselines(
    df: DataFrame, id_col: str, text: str, categories: Sequence[str], label: str, group: str, seed: int = 42,
    features: int = 1024, max_iter: int = 50,
) -> DataFrame:
    """(split, model, metrics): text, structured and combined classifiers on a random and a group-disjoint split.

    The gap between the two splits shows how much a model has memorised its groups.
    """
    rows = encode_inputs(df.filter(F.col(label).isin(0, 1)), [], categories).withColumn("label", F.col(label).cast("double"))
    rows = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    both = VectorAssembler(inputCols=["text_features", "structured"], outputCol="combined")
    # what no split changes, the words and their hashes, is made once; frequencies and categories are fitted on each
    stages = text_stages("_text", features=features)
    for stage in stages:
        if isinstance(stage, (RegexTokenizer, NGram, HashingTF)):
            rows = stage.transform(rows)
    hashed = [s.getOutputCol() for s in stages if isinstance(s, HashingTF)]
    folder = work_folder(df.sparkSession, "baselines")
    rows.select(id_col, group, "label", *hashed, *[f"_c_{c}" for c in categories]).write.parquet(f"{folder}/rows")
    rows = df.sparkSession.read.parquet(f"{folder}/rows")
    fitted_stages = [s for s in stages if not isinstance(s, (RegexTokenizer, NGram, HashingTF))]
    prepare = Pipeline(stages=[*fitted_stages, encoder([], categories), both])
    logistic = lambda column: LogisticRegression(featuresCol=column, weightCol="weight", maxIter=max_iter)
    models = {
        "text_logistic": logistic("text_features"),
        "text_svm": LinearSVC(featuresCol="text_features", weightCol="weight", maxIter=max_iter),
        "structured_logistic": logistic("structured"),
        "combined_logistic": logistic("combined"),
    }
    out = None
    for kind in ("random", "grouped"):
        parts = split(rows, id_col, 0.2, seed, group if kind == "grouped" else None)
        fitted = prepare.fit(parts.filter("part = 'train'"))
        ready = fitted.transform(parts).select("label", "part", "text_features", "structured", "combined").persist()
        train = class_weight(ready.filter("part = 'train'")).persist()
        for name, classifier in models.items():
            tested = classifier.fit(train).transform(ready.filter("part = 'test'"))
            # the margin of the linear model is a score whose cut is 0
            margin = name == "text_svm"
            value = vector_to_array("rawPrediction" if margin else "probability").getItem(1)
            # scores are few beside the vectors, and read several times
            tested.select(value.alias("score"), (F.col("label") == 1).alias("y")).write.parquet(f"{folder}/scored/{kind}/{name}")
            scored = df.sparkSession.read.parquet(f"{folder}/scored/{kind}/{name}")
            line = ranking_metrics(scored, "score", "y", 0.0 if margin else 0.5)
            line = line.withColumns({"split": F.lit(kind), "model": F.lit(name)})
            out = line if out is None else out.unionByName(line)
        train.unpersist()
        ready.unpersist()
    return out


def generalisation_gap(metrics: DataFrame) -> DataFrame:
    """(model, roc_auc_drop, f1_drop, collapse) from the random to the grouped split."""
    pick = lambda kind, column: F.max(F.when(F.col("split") == kind, F.col(column)))
    both = metrics.groupBy("model").agg(
        (pick("random", "roc_auc") - pick("grouped", "roc_auc")).alias("roc_auc_drop"),
        (pick("random", "f1") - pick("grouped", "f1")).alias("f1_drop"),
    )
    return both.withColumns({
        "roc_auc_drop": rounded(F.col("roc_auc_drop")), "f1_drop": rounded(F.col("f1_drop")),
        "collapse": (F.col("roc_auc_drop") > 0.15) | (F.col("f1_drop") > 0.20),
    })
