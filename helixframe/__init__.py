"""Spark jobs for haplotype signals: case-control analysis of per-base scores on long tables."""
