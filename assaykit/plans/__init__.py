"""Query catalogue over the standard tables, with SQL twins."""

from . import evidence, measures, records, rules, sets, structures, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evidence", "measures", "records", "rules", "sets", "structures", "texts"]
