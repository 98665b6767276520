"""Lineage, checks and stage levels as DataFrame jobs over tables of declarations."""
