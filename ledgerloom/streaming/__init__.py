"""Stateful operators: folds shared by batch and streaming."""
