"""Reconciliation, segmentation and quality analytics over extracted documents, built from Spark DataFrame operators."""
