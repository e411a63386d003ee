"""Readers and writers for the text formats that assay pipelines exchange."""
