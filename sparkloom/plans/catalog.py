"""What a query plan may refer to: the columns of a table, their kinds and known values."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("integer", "number")
ORDERED = ("integer", "number", "date")
MAX_VALUES = 60


def kind_of(data_type: T.DataType) -> str:
    """integer, number, text, date, boolean or other."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "boolean" if isinstance(data_type, T.BooleanType) else "other"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    kind: str
    values: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict, hash=False)
    synonyms: tuple[str, ...] = ()
    additive: bool = True


@dataclass(frozen=True)
class Catalog:
    columns: tuple[ColumnInfo, ...]

    @classmethod
    def of(cls, df: DataFrame, values_of: tuple[str, ...] = (), **overrides: dict) -> Catalog:
        """The catalogue of df; the columns in values_of get their distinct values where there are at most MAX_VALUES."""
        infos = []
        for f in df.schema.fields:
            info = ColumnInfo(f.name, kind_of(f.dataType))
            if f.name in values_of:
                rows = df.where(F.col(f.name).isNotNull()).groupBy(f.name).count().orderBy(F.desc("count"), f.name).limit(MAX_VALUES + 1).collect()
                info = replace(info, values=tuple(str(r[0]) for r in rows) if len(rows) <= MAX_VALUES else ())
            infos.append(replace(info, **overrides.get(f.name, {})))
        return cls(tuple(infos))

    def find(self, name: str) -> ColumnInfo | None:
        """By name, whatever its case."""
        return next((c for c in self.columns if c.name.lower() == name.strip().lower()), None)

    def hints(self, name: str) -> list[str]:
        """Names that the given one may have meant."""
        lower = {c.name.lower(): c.name for c in self.columns}
        return [lower[x] for x in difflib.get_close_matches(name.strip().lower(), lower, n=3, cutoff=0.6)]
