"""End-to-end pipelines, the provider hook and the catalogue of queries."""
