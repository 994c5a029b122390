"""Analytics over repeated-route trip telemetry, expressed as Spark DataFrame plans."""
