"""Readers: file trees, log files, document tables."""
