"""Table functions: called with LATERAL in SQL, or with lateralJoin from DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpus_engine.operators.quality import RULES, places_of
from corpus_engine.shared import ship


@udtf(useArrow=True)
class FindingPlaces:
    """finding_places(text[, rules]) -> rule, position, length of every finding of the text; null text: none.

    rules: a constant, rule names with commas between; by default all. Arguments are checked when the query is analysed.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, rules: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("finding_places: text must be a string")
        if rules is not None:
            if not rules.isConstantExpression or not isinstance(rules.value, str):
                raise ValueError("finding_places: rules must be a constant string")
            if unknown := set(rules.value.split(",")) - set(RULES):
                raise ValueError(f"finding_places: no such rule: {', '.join(sorted(unknown))}")
        return AnalyzeResult(T.StructType().add("rule", T.StringType()).add("position", T.IntegerType()).add("length", T.IntegerType()))

    def eval(self, text: str | None, rules: str | None = None) -> Iterator[tuple[str, int, int]]:
        yield from places_of(text or "", tuple(rules.split(",")) if rules else tuple(RULES))


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL under their names."""
    ship(spark)
    spark.udtf.register("finding_places", FindingPlaces)
