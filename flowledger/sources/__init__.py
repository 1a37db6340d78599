"""Readers of traces, reports, run headers and manifests."""
