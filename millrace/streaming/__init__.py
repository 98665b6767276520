"""Flows are batch only; this package holds the refusal of streaming results."""
