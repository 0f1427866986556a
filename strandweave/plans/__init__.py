"""Registered queries: pipelines of operators over the tables, with their SQL."""
