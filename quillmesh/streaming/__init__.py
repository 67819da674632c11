"""Structured Streaming flows; each has a batch twin."""
from .flows import *  # noqa: F401,F403
