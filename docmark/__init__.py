"""Files to Markdown, and the progress of their conversion, as Spark DataFrames."""

from docmark.limits import Limits

__all__ = ["Limits"]
