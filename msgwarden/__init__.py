"""Checking, scoring and comparing large tables of text messages on Spark."""
