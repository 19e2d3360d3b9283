"""Readers (S1-S4) and writers (K1-K3)."""

from sitesift.sources.readers import *  # noqa: F401,F403
from sitesift.sources.sinks import *  # noqa: F401,F403
