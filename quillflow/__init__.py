"""quillflow: news-feed ingestion and analytics on Spark DataFrames."""

from .session import build_session, scratch_dir, written

__all__ = ["build_session", "scratch_dir", "written"]
