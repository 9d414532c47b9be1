"""Learners that Spark ML does not have."""
