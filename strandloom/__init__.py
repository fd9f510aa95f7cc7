"""Strandloom: sequence, interval and graph analytics as Spark DataFrame plans."""
