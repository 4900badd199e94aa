"""Operators for large training-data pipelines (see README, section "Training-data operators")."""
