"""Boosted trees per member, group softmax on their margins, isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import isotonic, metrics
from wakeline.operators.groups import group_softmax, renormalise_group
from wakeline.operators.isotonic import interpolated
from wakeline.operators.splits import walk_forward_folds, years
from wakeline.schema import DEPLOYABLE_SETS, RACE_KEYS, feature_columns
from wakeline.session import staged

GBT_PARAMS = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42,
              "minInstancesPerNode": 200}


@dataclass(frozen=True)
class Calibrator:
    """Monotone map from probability to observed frequency, kept as a table of knots (x, y)."""

    knots: DataFrame

    def map(self, df: DataFrame, column: str = "p_win") -> DataFrame:
        return interpolated(df, column, self.knots)

    def apply(
        self,
        df: DataFrame,
        keys: Sequence[str] = RACE_KEYS,
        column: str = "p_win",
        *,
        bounded: bool = False,
    ) -> DataFrame:
        return renormalise_group(self.map(df, column), keys, column, bounded=bounded)


def fit_calibrator(scored: DataFrame, label: str = "won", p: str = "p_win") -> Calibrator:
    """Isotonic fit on rows the model has not learned from, clipped to [0, 1]."""
    return Calibrator(staged(isotonic.knots(isotonic.isotonic_blocks(scored, p, label)), "knots"))


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    feature_names: list[str]
    feature_set: str
    calibrator: Calibrator | None = None
    metrics: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the logit: twice the boosted sum."""
        missing = [c for c in self.feature_names if c not in df.columns]
        if missing:
            raise ValueError(f"model needs columns that are not there: {missing}")
        out = self.pipeline.transform(df.drop("score"))
        margin = vector_to_array("rawPrediction")[1] * 2.0
        return out.select(*[c for c in df.columns if c != "score"], margin.alias("score"))

    def predict(
        self, df: DataFrame, *, calibrate: bool = True, bounded: bool = False
    ) -> DataFrame:
        """Add ``score`` and ``p_win``; probabilities sum to one in each group.

        Without ``bounded`` the scores are written once, since group totals read them again.
        """
        scored = self.score(df) if bounded else staged(self.score(df), "scores")
        scored = group_softmax(scored, bounded=bounded)
        if calibrate and self.calibrator is not None:
            scored = self.calibrator.apply(scored, bounded=bounded)
        return scored

    def importances(self, top: int = 20) -> list[tuple[str, float]]:
        """Features by gain; an indicator's gain counts for its feature."""
        values = self.pipeline.stages[-1].featureImportances.toArray()
        n = len(self.feature_names)
        gain = {f: float(values[i] + values[n + i]) for i, f in enumerate(self.feature_names)}
        return sorted(gain.items(), key=lambda kv: (-kv[1], kv[0]))[:top]

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = (self.feature_names, self.feature_set, self.calibrator is not None,
               {k: float(v) for k, v in self.metrics.items()})
        spark.createDataFrame(
            [row],
            "feature_names ARRAY<STRING>, feature_set STRING, calibrated BOOLEAN, "
            "metrics MAP<STRING, DOUBLE>",
        ).write.mode("overwrite").parquet(f"{path}/sidecar")
        if self.calibrator is not None:
            self.calibrator.knots.write.mode("overwrite").parquet(f"{path}/knots")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        side = spark.read.parquet(f"{path}/sidecar").first()
        knots = Calibrator(spark.read.parquet(f"{path}/knots")) if side["calibrated"] else None
        return cls(PipelineModel.load(f"{path}/pipeline"), list(side["feature_names"]),
                   side["feature_set"], knots, dict(side["metrics"]))


def _stages(names: Sequence[str], label: str, params: dict) -> list:
    """Trees reject NaN, so a missing value becomes 0 next to an indicator."""
    fields = ", ".join(
        f"coalesce(nanvl(CAST({c} AS DOUBLE), NULL), 0.0D) AS _f{i}, "
        f"CAST(nanvl(CAST({c} AS DOUBLE), NULL) IS NULL AS DOUBLE) AS _m{i}"
        for i, c in enumerate(names)
    )
    n = len(names)
    return [
        SQLTransformer(statement=f"SELECT *, {fields} FROM __THIS__"),
        VectorAssembler(
            inputCols=[f"_f{i}" for i in range(n)] + [f"_m{i}" for i in range(n)],
            outputCol="_features",
        ),
        GBTClassifier(
            featuresCol="_features", labelCol=label, validationIndicatorCol="_valid",
            **{**GBT_PARAMS, **params},
        ),
    ]


def train(
    fit: DataFrame,
    holdout: DataFrame,
    *,
    label: str = "won",
    feature_set: str = "morning",
    params: dict | None = None,
) -> TrainedModel:
    """Boosted trees on ``fit``; boosting stops when ``holdout`` no longer improves."""
    names = [c for c in feature_columns(feature_set) if c in fit.columns]
    if not names:
        raise ValueError("no usable feature columns present")
    columns = [*names, label]
    both = (
        fit.select(*columns).withColumn("_valid", F.lit(False))
        .unionByName(holdout.select(*columns).withColumn("_valid", F.lit(True)))
    )
    fitted = Pipeline(stages=_stages(names, label, params or {})).fit(both)
    return TrainedModel(fitted, names, feature_set)


def train_calibrated(fit: DataFrame, holdout: DataFrame, **options) -> TrainedModel:
    """Train, then calibrate on the hold-out; its metrics are therefore optimistic."""
    model = train(fit, holdout, **options)
    model.calibrator = fit_calibrator(model.predict(holdout, calibrate=False),
                                      options.get("label", "won"))
    return model


def require_deployable(model: TrainedModel) -> TrainedModel:
    """Refuse a model that needs columns not known when it has to run."""
    if model.feature_set not in DEPLOYABLE_SETS:
        raise ValueError(
            f"a {model.feature_set!r} model needs columns published after the card; "
            f"use one of {list(DEPLOYABLE_SETS)}"
        )
    return model


def evaluate(
    model: TrainedModel, df: DataFrame, label: str = "won", *, optimistic: bool = False
) -> DataFrame:
    scored = model.predict(df)
    return metrics.evaluate(scored, "p_win", label).withColumn("optimistic", F.lit(optimistic))


def walk_forward(
    df: DataFrame, first: int, last: int, *, feature_set: str = "morning", label: str = "won",
    params: dict | None = None, min_past_rows: int = 10_000,
) -> list[dict]:
    """Retrain on everything before year Y-1, stop on Y-1, evaluate on Y.

    A fold that cannot be used is returned with the reason. The loop runs over the years; each fit and evaluation is a distributed job on rows
    that are written once.
    """
    df = staged(df, "folds")
    folds = walk_forward_folds(df, first, last, min_past_rows=min_past_rows)
    out = []
    for fold in sorted(folds.collect(), key=lambda r: r["eval_year"]):
        year = fold["eval_year"]
        if fold["skipped"]:
            out.append({"eval_year": year, "train_rows": fold["train_rows"], "skipped": fold["skipped"]})
            continue
        fit = df.filter(F.col("race_date") < F.lit(f"{year - 1}-01-01").cast("date"))
        model = train(fit, years(df, year - 1, year - 1), label=label,
                      feature_set=feature_set, params=params)
        row = metrics.evaluate(model.predict(years(df, year, year)), "p_win", label).first()
        out.append({"eval_year": year, "train_rows": fold["train_rows"], "rows": row["rows"],
                    "brier": row["brier"], "roc_auc": row["roc_auc"], "skipped": None,
                    "trees": len(model.pipeline.stages[-1].trees)})
    return out
