"""Sensor-stream analytics on Spark."""
