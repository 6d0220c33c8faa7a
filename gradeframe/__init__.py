"""gradeframe: multiple-choice benchmark analytics as ordinary Spark jobs."""

__version__ = "0.1.0"
