"""Readers and writers: landing pages, typed table, yearly partitions, marts, run history."""
