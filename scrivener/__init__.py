"""Transcript quality analytics on Spark."""
