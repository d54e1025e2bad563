"""Operators of a training-data pipeline: text in, decisions, labels, scores and encodings out."""
