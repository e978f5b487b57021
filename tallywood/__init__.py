"""Tallywood: evidence analytics over changing tables and documents, on Spark."""
