"""Registered queries, their SQL oracles and the table binding both use."""
