"""Readers and writers of the text formats, and genotypes derived from test tables."""
