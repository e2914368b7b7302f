"""Helpers that shape physical plans: cutting lineage, sizing partitions."""

from arcweave.plans.materialize import discard, materialize, shared_dir, stat

__all__ = ["discard", "materialize", "shared_dir", "stat"]
