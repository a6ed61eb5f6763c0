"""Operators of the evidence-curation engine."""
