"""Every query of the library outside the training-data subpackage, with its DuckDB SQL."""

from __future__ import annotations

from corpusops.plans import activity, catalogs, corpus, ingestion, questions, retrieval, streams  # noqa: F401  importing registers
from corpusops.plans.registry import ORACLE, QUERIES  # noqa: F401
