"""The query catalogue of the core library: names to (spark, folder) functions, and DuckDB SQL with the same rows."""

from . import corpora, documents, fields, layout, relational, scoring, texts, time  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
