"""Every operator as a query over the given tables, next to the SQL it must equal."""

from corpus_spark.catalog import cleaning, evaluation, storage, training  # noqa: F401
from corpus_spark.catalog.registry import ORACLES, QUERIES  # noqa: F401
