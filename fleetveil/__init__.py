"""Private analytics over device-fleet telemetry, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
