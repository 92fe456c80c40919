"""Whole plans: the registered queries and the ingestion job."""
