"""Whole-pipeline plans, and the bindings and queries over the test tables."""
