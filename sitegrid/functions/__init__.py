"""Scalar functions over columns."""

from .scalar import *  # noqa: F403
