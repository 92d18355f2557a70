"""Readers and writers of genomic files."""
