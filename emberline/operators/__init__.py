"""DataFrame operators: ingestion, enrichment, classification, pruning, serving, facilities."""
