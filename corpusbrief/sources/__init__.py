"""Readers and writers: directory trees, tables and file queues."""
