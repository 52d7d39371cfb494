"""End-to-end plans composed from operators: feature table, training, scoring, comparison."""
