"""Registered queries: each operator on the driver's tables, projected into the operator's shapes."""

from corvid.plans import q_graph, q_scalar, q_stats, q_triage  # noqa: F401
