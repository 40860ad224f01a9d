"""Inputs derived from the test tables, the published queries, their oracles."""
