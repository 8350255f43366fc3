"""All queries of the engine and their SQL."""

from parley.plans import archive_queries, document_queries, record_queries, relational_queries, search_queries, sequence_queries, service_queries, source_queries, storage_queries, usage_reports
from parley.plans.tables import ORACLES, QUERIES

FLAGSHIP = usage_reports.flagship
MODULES = (usage_reports, sequence_queries, search_queries, relational_queries, document_queries, record_queries, source_queries, storage_queries, service_queries, archive_queries)

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
