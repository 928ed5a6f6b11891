"""Sequences of Spark jobs and the registered queries."""
