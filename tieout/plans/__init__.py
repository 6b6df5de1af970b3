"""Whole reconciliation runs, put together from operators."""
