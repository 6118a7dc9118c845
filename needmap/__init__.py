"""needmap: where is a public service missing? PySpark operators from raw tables to a review queue."""

from . import config

__all__ = ["config"]
