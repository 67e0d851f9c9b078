"""The registered queries with the SQL that checks them."""

from seqtables.catalog import files, flagship, joins, models, rows, sequences, statistics  # noqa: F401
from seqtables.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
