"""Rules on column, target, task and model names; resolved on the driver from the schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions import constants as K

REGRESSION, BINARY, MULTICLASS = "regression", "binary_classification", "multiclass_classification"
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def normalize_header(name: object) -> str:
    return re.sub("[^a-z0-9]", "", str(name).lower())


def normalize_header_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def sequence_keys() -> list[str]:
    return list(dict.fromkeys(normalize_header(n) for n in K.SEQUENCE_COLUMN_NAMES))


def is_numeric_type(dtype: str) -> bool:
    return dtype in _NUMERIC or dtype.startswith("decimal")


def target_columns(df: DataFrame) -> list[str]:
    """Columns whose name hints at a measured property, then the other numeric ones except an id."""
    hinted = [c for c in df.columns if any(h in c.lower() for h in K.TARGET_COLUMN_HINTS)]
    numeric = [c for c, dtype in df.dtypes if is_numeric_type(dtype)]
    return hinted + [c for c in numeric if c not in hinted and c.lower().strip() != "id"]


def _direction(name: str, hints: Iterable[str]) -> str:
    return "minimize" if any(h in name for h in hints) else "maximize"


def scoring_direction(target: str | None) -> str:
    """Direction used when predictions are ranked; underscores and blanks do not count."""
    return _direction(re.sub("[_ ]", "", (target or "").lower()), K.SCORING_MINIMIZE_HINTS)


def design_direction(target: str | None) -> str:
    """Direction used by the design statistics; a different hint list than for scoring."""
    return _direction((target or "").lower(), K.DESIGN_MINIMIZE_HINTS)


def resolve_direction(direction: str, target: str) -> str:
    return design_direction(target) if direction == "auto" else direction


def task_type(name: str | None) -> str:
    task = (name or REGRESSION).strip().lower().replace("-", "_")
    if task == "multi_class" or ("multi" in task and "class" in task):
        return MULTICLASS
    if task == "binary" or "class" in task:
        return BINARY
    return REGRESSION


def is_classification(name: str | None) -> bool:
    return task_type(name) != REGRESSION


# Model family by parts of the model name; the first line that matches wins.
_FAMILIES = (
    ("Linear", ("linear", "ridge", "lasso", "elastic", "logistic")),
    ("Nonlinear Kernel", ("svr", "svm")),
    ("Nonlinear Distance", ("knn",)),
    ("Tree Ensemble", ("forest", "boost", "xgboost", "lightgbm", "tree")),
    ("Neural", ("mlp",)),
    ("Probabilistic", ("bayes",)),
)


def model_family(model: str) -> str:
    name = model.lower()
    return next((family for family, parts in _FAMILIES if any(p in name for p in parts)), "Other")
