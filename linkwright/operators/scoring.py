"""Features, the random forest, and scored pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions

PREDICTORS = ("zip_dist", "year_dist", "full_name_sim", "mid_initial_agree", "mid_name_agree", "n", "occ_medical", "occ_unknown")
MISSING = -1.0


def feature_columns(frame: DataFrame, occupation: str = "CommercialData_Occupation") -> DataFrame:
    """The eight predictors as doubles (NULL stays NULL), beside the other columns."""
    job = F.col(occupation)
    frame = frame.withColumns({"occ_medical": mentions(job, "Medical").cast("int"), "occ_unknown": F.coalesce(job == "Unknown", F.lit(True)).cast("int")})
    return frame.withColumns({c: F.col(c).cast("int" if dict(frame.dtypes).get(c) == "boolean" else "double").cast("double") for c in PREDICTORS})


def with_missing_flags(frame: DataFrame) -> DataFrame:
    """The forest takes no NULL: a value outside every range, and a flag of its own, stand for it."""
    values = {f"x_{c}": F.coalesce(F.nanvl(c, F.lit(MISSING)), F.lit(MISSING)) for c in PREDICTORS}
    return frame.withColumns(values | {f"m_{c}": F.col(c).isNull().cast("double") for c in PREDICTORS})


def train_forest(labelled: DataFrame, label: str = "match", trees: int = 2_000, depth: int = 16, leaf: int = 5, share: float = 0.5, seed: int = 7) -> PipelineModel:
    """A probability forest: trees on half of the rows each, all predictors at every split, leaves of at least five rows."""
    rows = with_missing_flags(feature_columns(labelled)).withColumn("label", F.col(label).cast("double"))
    inputs = [f"{p}_{c}" for c in PREDICTORS for p in ("x", "m")]
    forest = RandomForestClassifier(numTrees=trees, seed=seed, minInstancesPerNode=leaf, maxDepth=depth, subsamplingRate=share, bootstrap=False, featureSubsetStrategy="all")
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), forest]).fit(rows)


def candidate_count(pairs: DataFrame, *keys: str) -> DataFrame:
    """n: how many candidates the row's entity has."""
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def score_pairs(model: PipelineModel, *stages: DataFrame, keys: tuple[str, ...] = ("npi", "year")) -> DataFrame:
    """All stages' pairs with n over both and match_prob; missing columns of a stage are NULL."""
    union = stages[0]
    for s in stages[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    counted = candidate_count(union, *keys)
    scored = model.transform(with_missing_flags(feature_columns(counted)))
    return scored.withColumn("match_prob", vector_to_array("probability")[1]).select(*[f"`{c}`" for c in counted.columns], "match_prob")
