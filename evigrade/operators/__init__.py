"""Relational and grouped operators of the calibration pipeline."""
