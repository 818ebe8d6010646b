"""Structured Streaming: a watched folder as a source, batches with a timeout, and stopping on a condition."""

from .batches import batch_stream
from .control import stop_when
from .watch import DirectoryWatch, watch_directory

__all__ = ["DirectoryWatch", "batch_stream", "stop_when", "watch_directory"]
