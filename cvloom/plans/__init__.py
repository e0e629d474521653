"""Composed plans: the document pipeline and the query catalogue."""
