"""Review-sentiment analytics as PySpark DataFrame jobs."""

from opinelake.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
