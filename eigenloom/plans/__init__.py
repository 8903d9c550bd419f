"""Experiments: folds, grids of erasers, and what they leave."""
