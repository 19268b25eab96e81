"""Trained agents: a text model with temperature and explanations, and forests over fixed features.

Weights are trained here on labelled rows (``fit_*``) and saved as Spark ML
folders; what must agree across deployments is the interface.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.functions import dims
from threshline.functions.text import collapse_invisible, without_invisible

VOCABULARY = 1 << 14


def fit_text(rows: DataFrame, text_col: str = "text", label_col: str = "label", iterations: int = 20) -> PipelineModel:
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}<>]+"),
        CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=VOCABULARY, minDF=2.0, binary=True),
        LogisticRegression(featuresCol="_counts", labelCol=label_col, maxIter=iterations, regParam=0.01, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_said"),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn(label_col, F.col(label_col).cast("double")))


def score_text(rows: DataFrame, model: PipelineModel, temperature: float = 1.0, text_col: str = "text", out: str = "p_text") -> DataFrame:
    """Probability with the margin divided by a temperature."""
    d = model.transform(rows)
    margin = vector_to_array("_raw")[1] / temperature
    return d.withColumn(out, 1 / (1 + F.exp(-2 * margin / 2))).drop("_words", "_counts", "_raw", "_prob", "_said")


def text_agent(rows: DataFrame, model: PipelineModel, temperature: float = 1.0, text_col: str = "text") -> DataFrame:
    """The larger score of the text as shown and as written."""
    shown = score_text(rows.withColumn("_t", F.col(text_col)).withColumn(text_col, without_invisible(F.col("_t"))), model, temperature, text_col, "p_shown")
    written = score_text(shown.withColumn(text_col, collapse_invisible(F.col("_t"))), model, temperature, text_col, "p_written")
    return written.withColumn("p_text", F.greatest("p_shown", "p_written")).withColumn(text_col, F.col("_t")).drop("_t", "p_shown", "p_written")


def explain(rows: DataFrame, model: PipelineModel, key: str, text_col: str = "text", most: int = 10) -> DataFrame:
    """(key, token, weight, rank): the words that moved a score most; function words are left out, as are texts under five words."""
    weights = model.stages[2].coefficients.toArray()
    table = rows.sparkSession.createDataFrame([(w, float(c)) for w, c in zip(model.stages[1].vocabulary, weights, strict=True) if c], "token string, weight double")
    keep = "account click here please dear thank thanks merci bonjour".split()
    stop = [w for ws in dims.keyed(dims.FUNCTION_WORDS).values() for w in ws if w not in keep]
    tokens = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}<>]+"), lambda w: w != "")
    d = rows.select(key, tokens.alias("ts")).where(F.size("ts") >= 5).select(key, F.explode(F.array_distinct("ts")).alias("token"))
    d = d.where(~F.col("token").isin(stop)).join(F.broadcast(table), "token")  # VOCABULARY rows at most
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("weight")), "token"))
    return d.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "token", "weight", "rank")


def fit_forest(rows: DataFrame, features: list[str], label_col: str = "label", trees: int = 30) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
        RandomForestClassifier(featuresCol="_s", labelCol=label_col, numTrees=trees, maxDepth=6, seed=7, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_said"),
    ]
    return Pipeline(stages=stages).fit(rows.fillna(0, features).withColumn(label_col, F.col(label_col).cast("double")))


def score_forest(rows: DataFrame, model: PipelineModel, out: str = "phishing_probability") -> DataFrame:
    """Missing features count as 0; adds the probability and its label at .5."""
    names = model.stages[0].getInputCols()
    missing = {n: F.lit(0) for n in names if n not in rows.columns}
    d = model.transform(rows.withColumns(missing).fillna(0, names) if missing else rows.fillna(0, names))
    return d.withColumn(out, vector_to_array("_prob")[1]).withColumn("said", F.when(F.col(out) >= 0.5, "phishing").otherwise("safe")).drop("_v", "_s", "_prob", "_raw", "_said", *missing)
