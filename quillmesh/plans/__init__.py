"""Plans: the engine's operators put together over the driver's tables, each with its SQL where SQL can express it."""

from quillmesh.plans import basics, landed, retrieve, sync  # noqa: F401
from quillmesh.plans.registry import ORACLES, QUERIES  # noqa: F401
