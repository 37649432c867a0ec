"""Operators for preparing large training corpora, and the queries that apply them to whole tables."""
