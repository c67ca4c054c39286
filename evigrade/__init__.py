"""Spark jobs that calibrate experimental assay scores into graded evidence."""
