"""Demonstration-log and corpus analytics as plain PySpark DataFrame functions."""
