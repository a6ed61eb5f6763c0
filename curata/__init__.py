"""Evidence-curation analytics on Spark."""
