"""The unified answers schema, task registry and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

TEXT = ("question_id", "question", "reference_answer", "student_answer")
COLUMNS = (*TEXT, "score", "label", "dataset", "domain", "split")
ANSWERS = StructType([StructField(c, DoubleType() if c == "score" else StringType(), c == "score") for c in COLUMNS])
KEYS = ("question_id", "score", "label", "dataset", "domain", "split", "fold")


def coerce(df: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``df`` in the unified schema: missing columns added, text never null, score null unless numeric, extras dropped."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    number = F.expr("try_cast(score AS DOUBLE)") if "score" in have else F.lit(None).cast("double")
    score = F.when(~F.isnan(number), number)
    return df.select(*[c for c in keep if c in have], *[(score if c == "score" else text(c)).alias(c) for c in COLUMNS])


def column_report(df: DataFrame) -> dict:
    """Missing and extra column names against the schema; no job."""
    return {"missing": sorted(set(COLUMNS) - set(df.columns)), "extra": sorted(set(df.columns) - set(COLUMNS)), "n_cols": len(df.columns)}


@dataclass(frozen=True)
class Task:
    """How a dataset is trained and judged."""

    name: str
    kind: str  # classification | ordinal | regression
    target: str  # label | score
    protocol: str  # official | kfold
    headline: str
    metrics: tuple[str, ...]
    per_prompt: bool = False
    test_splits: tuple[str, ...] = ()


#: Target, protocol, metrics and test splits of each corpus.
TASKS = {
    t.name: t
    for t in (
        Task("semeval", "classification", "label", "official", "macro_f1", ("macro_f1", "weighted_f1", "accuracy"), test_splits=("test_ua", "test_uq", "test_ud")),
        Task("saf", "regression", "score", "official", "pearson", ("rmse", "mae", "pearson", "spearman"), test_splits=("test_ua", "test_uq")),
        Task("asap_sas", "ordinal", "score", "official", "qwk", ("qwk", "accuracy"), per_prompt=True, test_splits=("test_ua",)),
        Task("mohler", "regression", "score", "kfold", "pearson", ("pearson", "spearman", "rmse", "mae")),
        Task("powergrading", "classification", "label", "kfold", "macro_f1", ("macro_f1", "accuracy", "qwk")),
        Task("mindreading", "ordinal", "score", "kfold", "qwk", ("qwk", "accuracy")),
    )
}


@dataclass(frozen=True)
class Config:
    """Settings of every stage; ``load`` overrides them from YAML or a dict, unknown names are an error."""

    cv_k_folds: int = 5
    near_duplicate: float = 0.95
    negation_window: int = 4
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int = 2
    tau: float = 0.5
    n_boot: int = 10_000
    ci: float = 0.95
    seed: int = 42
    seeds: tuple[int, ...] = (42, 1, 2, 3, 4)
    n_trials: int = 40
    inner_folds: int = 3
    branches: tuple[str, ...] = ("lexical", "tfidf", "negation", "entities", "semantic", "rubric")
    dedupe: tuple[str, ...] = ("mohler", "powergrading", "mindreading")
    gbt: dict = field(default_factory=lambda: {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31, "min_child_samples": 20, "subsample": 1.0, "colsample": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0})

    @classmethod
    def load(cls, source: dict | str | None = None) -> Config:
        if isinstance(source, str):
            import yaml

            with open(source) as f:
                source = yaml.safe_load(f)
        unknown = set(source or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in (source or {}).items()})
