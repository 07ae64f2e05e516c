"""Whole jobs: linting, font safety, attribution, dataset work and evaluation as DataFrame plans."""
