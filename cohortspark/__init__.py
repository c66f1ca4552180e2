"""Hospital-event cohorts and real-versus-synthetic table evaluation on Spark DataFrames."""

from cohortspark.session import get_session

__all__ = ["get_session"]
