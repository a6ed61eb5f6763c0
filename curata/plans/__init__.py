"""Plans of the evidence-curation engine."""
