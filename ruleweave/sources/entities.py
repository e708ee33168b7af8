"""Entity views: tables or facts as one row for each entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without a zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


@dataclass(frozen=True)
class EntityView:
    """Rows of one entity type: an id column and typed attributes.

    on_error says what a computed condition gives where it can't be evaluated (a missing operand, a division by zero):
    keep (the default), drop or fail. context holds values of the run, such as `today`.
    """

    df: DataFrame
    id: str
    name: str = "entity"
    on_error: str = "keep"
    context: dict = field(default_factory=dict)

    def column(self, attribute: str) -> Column:
        return F.col(f"`{attribute}`")

    def has(self, attribute: str) -> bool:
        return attribute in self.df.columns

    def kind(self, attribute: str) -> str:
        """number, string, bool, list, time or other."""
        t = self.df.schema[attribute].dataType
        for kind, classes in (("bool", T.BooleanType), ("number", T.NumericType), ("string", T.StringType), ("list", T.ArrayType), ("time", (T.DateType, T.TimestampType, T.TimestampNTZType))):
            if isinstance(t, classes):
                return kind
        return "other"

    def strings(self) -> list[str]:
        return [c for c in self.df.columns if self.kind(c) == "string"]

    def with_df(self, df: DataFrame) -> EntityView:
        return EntityView(df, self.id, self.name, self.on_error, self.context)


def from_facts(facts: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """One row for each entity of (entity, attribute, value string) facts, with the attributes cast to the types given.

    A value that doesn't cast is null. The attributes are named by the caller, so no scan is needed to find them, and
    the pivot is one aggregate on the entity.
    """
    cells = [F.max(F.when(F.col("attribute") == a, F.col("value"))).try_cast(t).alias(a) for a, t in attributes.items()]
    return facts.where(F.col("attribute").isin(*attributes)).groupBy(F.col("entity").alias("id")).agg(*cells)


def to_facts(view: EntityView) -> DataFrame:
    """(entity, attribute, value string) of all attributes that are present."""
    own = [c for c in view.df.columns if c != view.id]
    cells = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in own]), F.array(*[view.column(c).cast("string") for c in own])))
    return view.df.select(F.col(view.id).alias("entity"), cells.alias("attribute", "value")).where("value is not null")


def records(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given records, as tests and models use them; absent attributes are null."""
    names = T.StructType.fromDDL(schema).fieldNames() if hasattr(T.StructType, "fromDDL") else [p.split()[0] for p in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
