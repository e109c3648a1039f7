"""Event streams: logs, progress and telemetry, in batch and as Structured Streaming."""
