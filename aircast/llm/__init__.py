"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  The queries
are registered by ``aircast.llm.catalog``.
"""
