"""Streaming of the evidence-curation engine."""
