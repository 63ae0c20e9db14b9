"""Governed-workflow analytics as DataFrame operators for Spark."""
