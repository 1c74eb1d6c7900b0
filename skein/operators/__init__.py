"""Operators over flows."""

from .flow import Flow, Single

__all__ = ["Flow", "Single"]
