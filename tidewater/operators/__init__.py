"""Relational operators."""

from tidewater.operators.relational import *  # noqa: F401,F403
