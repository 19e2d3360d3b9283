"""Structured Streaming versions of the page queue, the visited set and the rate audit."""

from sitesift.streaming.jobs import *  # noqa: F401,F403
