"""Query plans over the driver's tables, each with the SQL it is checked against."""

from refloom.plans import answers, evaluation, gold, pipeline, references, relational, relevance, services, structure, tables, text  # noqa: F401
from refloom.plans.registry import ORACLES, QUERIES  # noqa: F401
