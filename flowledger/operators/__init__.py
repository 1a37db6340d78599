"""Operators over fleets of workflow runs: every table is keyed by run_id."""
