"""All queries of the library, without those of the training-data subpackage."""

from corpusmill.plans import catalog, facts, findings, graph, members, properties, sources  # noqa: F401  (each registers its queries)
from corpusmill.plans.bindings import QUERIES, SQL

flagship = findings.audit_by_source

__all__ = ["QUERIES", "SQL", "flagship"]
