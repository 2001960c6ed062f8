"""Spark-native cohort matching, change provenance, labelling and evaluation operators."""
