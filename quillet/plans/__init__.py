"""Query plans over the driver's tables; importing this package registers them."""

from quillet.plans import detail_queries, evaluation_queries, record_queries, session_queries, source_queries, span_queries, text_queries  # noqa: F401
