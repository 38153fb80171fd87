"""Entity-behaviour analytics as Spark jobs.

Access events become per-entity behaviour profiles, causal features, detector
scores, a stateful risk score, alerts, adaptive profiles and evaluation tables.
"""
