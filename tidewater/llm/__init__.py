"""Operators for preparing large training corpora, each one a Spark job over whole tables."""
