"""Whole jobs composed from operators: dataset build, live features, scoring, training."""
