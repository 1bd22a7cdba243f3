"""Readers and writers for the text, delimited and XML formats of the pipeline."""
