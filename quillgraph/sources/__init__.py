"""Readers and writers: note trees, articles, dashboards, news tables."""
