"""Imports every registry module."""

from tidemark.registry import (  # noqa: F401
    aggs, drift, evaluation, features, joins, learning, preparation, quality, shaping, sources, streaming, tops, windows,
)
