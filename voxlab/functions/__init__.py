"""Scalar column functions (all JVM-side expressions)."""
from .scalar import *  # noqa: F401,F403
