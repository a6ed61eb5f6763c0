"""Sources of the evidence-curation engine."""
