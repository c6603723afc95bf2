"""Text classification: bag of words, a deterministic split, classifiers of Spark's library and boosted trees, and how well they do."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer, UnivariateFeatureSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators import boosting

#: Words of two letters or digits or more, as the usual vectoriser takes them.
NO_WORD = r"[^\p{L}\p{N}_]+"
SEED = 42
#: Columns of counted words: every word has one, by its hash. Trees look at every column, so they get those that a chi-square test finds bound to the label.
COLUMNS, CHANCE = 1 << 14, 0.05


def in_training(key: Column) -> Column:
    """Whether a row is one of the four fifths that are learned from; null keys are."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{SEED}"))), 1, 8)
    return F.coalesce(F.conv(digits, 16, 10).cast("long") % 5 > 0, F.lit(True))


def bag_of_words(text: str = "text", columns: int = COLUMNS) -> PipelineModel:
    """From texts to counted words."""
    return PipelineModel([RegexTokenizer(inputCol=text, outputCol="_words", pattern=NO_WORD, minTokenLength=2), HashingTF(inputCol="_words", outputCol="features", numFeatures=columns)])


def classifiers(labels: int) -> dict[str, object]:
    """Spark's classifiers by name; those that tell two classes only are asked for each label against the rest where there are more."""
    many = lambda c: c if labels <= 2 else OneVsRest(classifier=c, labelCol="_label")
    return {
        "naive_bayes": NaiveBayes(labelCol="_label"),
        "linear_svm": many(LinearSVC(labelCol="_label", maxIter=50)),
        "logistic_regression": LogisticRegression(labelCol="_label", maxIter=100),
        "random_forest": RandomForestClassifier(labelCol="_label", numTrees=50, maxBins=16, seed=SEED),
    }


def _reading(classifier, column: str):
    """``classifier`` over another column of features."""
    if isinstance(classifier, OneVsRest):
        return classifier.setFeaturesCol(column).setClassifier(classifier.getClassifier().setFeaturesCol(column))
    return classifier.setFeaturesCol(column)


def _boosted(training: DataFrame, rest: DataFrame, key: str, columns: list[int], labels: int) -> DataFrame:
    """``rest`` with the prediction of boosted trees; more labels than two are each told from the others, and the surest wins."""
    asked = [1] if labels == 2 else list(range(labels))
    kept = [key, "label"]
    for k in asked:
        model = boosting.fit(training, "features", F.when(F.col("_label") == k, 1.0).otherwise(-1.0), columns)
        rest = boosting.margins(rest, "features", [*kept, *(["features"] if k != asked[-1] else [])], model, f"_sure{k}")
        kept.append(f"_sure{k}")
    if labels == 2:
        return rest.withColumn("prediction", (F.col("_sure1") > 0).cast("int"))
    sure = F.array(*[F.col(f"_sure{k}") for k in asked])
    return rest.withColumn("prediction", F.array_position(sure, F.array_max(sure)) - 1)


def predicted(rows: DataFrame, key: str, label: str, name: str, text: str = "text") -> DataFrame:
    """(key, label, guess) of the rows that aren't learned from, by one classifier; labels are texts or numbers, rows without label or text are left out. Labels are worked out and
    texts cut into words once, and counted words held on disk: learning reads them many times over, and memory is for what it holds itself."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, F.col(label).cast("string").alias("label"), text)
    counted = bag_of_words(text).transform(known).select(key, "label", "features", in_training(F.col(key)).alias("_learned")).persist(StorageLevel.DISK_ONLY)
    training, rest = counted.where("_learned").select("label", "features"), counted.where("not _learned")
    index = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc").fit(training)
    if len(index.labels) < 2:
        found = rest.withColumn("guess", F.lit(index.labels[0] if index.labels else None).cast("string"))
    else:
        stages, shaped = [], index.transform(training)
        if name != "boosting":
            classifier = classifiers(len(index.labels))[name]
        if name in ("random_forest", "boosting"):
            chosen = UnivariateFeatureSelector(featuresCol="features", labelCol="_label", outputCol="_bound", selectionMode="fpr").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(CHANCE).fit(shaped)
            if chosen.selectedFeatures:
                stages, shaped = [chosen], shaped if name == "boosting" else chosen.transform(shaped)
                classifier = None if name == "boosting" else _reading(classifier, "_bound")
        if name == "boosting":
            told = _boosted(shaped, rest.select(key, "label", "features"), key, sorted(stages[0].selectedFeatures) if stages else list(range(COLUMNS)), len(index.labels))
        else:
            told = PipelineModel([*stages, classifier.fit(shaped)]).transform(rest)
        found = told.withColumn("guess", F.get(F.array(*[F.lit(x) for x in index.labels]), F.col("prediction").cast("int")))
    found = found.select(key, "label", "guess").persist(StorageLevel.DISK_ONLY)
    found.count()  # guesses are small, and held in place of the words
    counted.unpersist()
    return found


def agreement(rows: DataFrame, label: str = "label", guess: str = "guess") -> DataFrame:
    """(n, accuracy, kappa) of guesses; kappa is 0 where chance agrees always."""
    cells = rows.groupBy(F.col(label).alias("y"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("hit"))
    ys, ps = cells.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("a")), cells.groupBy(F.col("p").alias("v")).agg(F.sum("c").alias("b"))
    chance = ys.join(ps, "v").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("chance"))
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return n.join(F.broadcast(chance)).select("n", F.round(po, 4).alias("accuracy"), F.when(pe == 1, 0.0).otherwise(F.round((po - pe) / (1 - pe), 4)).alias("kappa"))
