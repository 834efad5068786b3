"""The usual preparation of a table for a model: categories to codes, medians for missing numbers, standard scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import OrdinalEncoder, OrdinalModel
from ..operators.frame import categorical_columns, continuous_columns, quantiles
from ..operators.scale import Scaler, ScalerModel


@dataclass
class Tabular:
    """target columns are left as they are. where: the rows that count for the fit."""

    categorical: list[str] | None = None
    continuous: list[str] | None = None
    target: list[str] = field(default_factory=list)
    where: str | None = None

    def fit(self, df: DataFrame) -> TabularModel:
        rows = df.where(self.where) if self.where else df
        cat = [c for c in (self.categorical or categorical_columns(df)) if c not in self.target]
        cont = [c for c in (self.continuous or continuous_columns(df)) if c not in self.target and c not in cat]
        row = rows.agg(*[F.max(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cont)]).first() if cont else None
        found = {r["variable"]: r["q"][0] for r in quantiles(rows, cont, [0.5]).collect()} if cont else {}  # a row for each column
        medians = {c: found.get(c) for c in cont}
        holes = [c for i, c in enumerate(cont) if row[f"n{i}"]]
        filled = rows.fillna({c: m for c, m in medians.items() if m is not None})
        return TabularModel(OrdinalEncoder(cat).fit(rows) if cat else None, medians, holes, Scaler(cont, eps=1e-7).fit(filled.withColumns({c: F.col(c).cast("double") for c in cont})) if cont else None)


@dataclass
class TabularModel:
    codes: OrdinalModel | None
    medians: dict[str, float]
    flagged: list[str]
    scores: ScalerModel | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Numbers that were missing in the fit have a flag c_na too."""
        df = self.codes.transform(df) if self.codes else df
        df = df.withColumns({f"{c}_na": F.col(c).isNull() for c in self.flagged})
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()})
        return self.scores.transform(df) if self.scores else df
