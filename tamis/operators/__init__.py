"""Preparation stages as Spark ML estimators."""
