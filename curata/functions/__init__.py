"""Functions of the evidence-curation engine."""
