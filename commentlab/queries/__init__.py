"""The registered queries over the given tables, each with its SQL twin where it has one."""

from commentlab.queries import features, metrics, models, sampling, sources, text  # noqa: F401
from commentlab.queries.base import REGISTRY

__all__ = ["REGISTRY"]
