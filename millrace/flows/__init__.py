"""Query bodies and pipelines over the test tables."""
