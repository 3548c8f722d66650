"""Whole preparation and scoring jobs, composed of the operators."""
