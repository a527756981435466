"""Production-telemetry analytics as Spark jobs."""

from spindle.session import configure, get_session, workspace

__all__ = ["configure", "get_session", "workspace"]
