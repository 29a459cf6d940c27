"""Whole plans: texts to findings, findings to reports."""
