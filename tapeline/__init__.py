"""Timeline analytics on Spark: frames to games, readings to names, intervals, histories, telemetry."""
