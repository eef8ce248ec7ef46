"""Event-time windows, the same plan over tables and streams (an extension)."""

from weft.streaming.windows import run_available, session_windows, sliding, tumbling

__all__ = ["run_available", "session_windows", "sliding", "tumbling"]
