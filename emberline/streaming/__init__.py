"""The micro-batch worker and resumable backfill."""
