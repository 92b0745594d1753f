"""Flockwise: simulation telemetry, regime-change statistics and discussion logs as Spark jobs."""
