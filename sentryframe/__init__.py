"""Spark threat-hunting analytics: telemetry in, findings, cases and coverage out."""
