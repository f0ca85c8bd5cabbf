"""Operators: features, scoring, predictions, filters, validation, reports,
warehouse, retention, semantic layer, preparation, evaluation, ML, windows."""
