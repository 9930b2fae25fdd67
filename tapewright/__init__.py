"""Tapewright: temporal analytics over annotated recordings, on PySpark.

Words, speaker turns, shots, frame observations and edit decisions are plain
DataFrames; every operator takes DataFrames and returns a DataFrame.
"""

__version__ = "0.1.0"
