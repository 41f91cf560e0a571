"""Catalog matching, embedding retrieval and label audits as Spark DataFrame plans."""
