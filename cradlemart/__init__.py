"""Marketplace analytics as Spark jobs: catalogue, social graph, ledger, writes, streams."""
