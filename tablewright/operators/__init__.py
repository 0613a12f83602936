"""Distributed building blocks: statistics, ordering, fills, groupings."""
