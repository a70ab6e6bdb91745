"""Readers and writers of collections, judgements, runs and indexes."""
