"""Workflow-run cost analytics and corpus preparation on Spark."""
