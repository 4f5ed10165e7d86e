"""Folds as plans, projections, domain objects and schema evolution."""
