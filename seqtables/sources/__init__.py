"""Readers and writers of sequence, annotation, hit and feature files."""
