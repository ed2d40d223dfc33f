"""Panel features and rank scoring on Spark."""

from panelspark.session import build_session, checkpoint_frame

__all__ = ["build_session", "checkpoint_frame"]
