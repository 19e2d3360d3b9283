"""Column expressions (built-in Spark functions only; JVM-side, codegen'd)."""

from sitesift.functions.text import *  # noqa: F401,F403
from sitesift.functions.urls import *  # noqa: F401,F403
