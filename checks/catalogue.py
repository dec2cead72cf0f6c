"""Imports every theme so that the registry is complete."""

from checks import features, hard, jobs, models, reports, scaling, slice, splitting, tables  # noqa: F401
from checks.registry import QUERIES, SQL  # noqa: F401
