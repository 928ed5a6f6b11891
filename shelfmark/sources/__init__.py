"""Readers and writers: record files, file listings, snapshots."""
