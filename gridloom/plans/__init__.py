"""Whole evaluations composed of operators."""
