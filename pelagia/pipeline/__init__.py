"""The daily pipeline: ingest, verify, index, retention, backfill."""
