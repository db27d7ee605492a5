"""The registered queries of the library and their SQL."""

from __future__ import annotations

from corpusgrid.plans import papers, retrieval, workflows

QUERIES = retrieval.QUERIES | papers.QUERIES | workflows.QUERIES
ORACLE = retrieval.ORACLE | papers.ORACLE | workflows.ORACLE
