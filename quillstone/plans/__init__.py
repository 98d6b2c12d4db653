"""Compositions of operators: retrieval, maintenance, reports, ingestion."""
