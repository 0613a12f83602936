"""tablewright: profile, clean, question and chart tables as Spark jobs."""

__version__ = "0.1.0"
