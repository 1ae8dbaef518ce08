"""Whole workloads put together from the operators."""
