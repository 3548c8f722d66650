"""Preparing and scoring reasoning and chat tables with Spark DataFrames."""

__version__ = "0.1.0"
