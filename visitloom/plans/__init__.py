"""Ready-made analyses over the given tables; importing this package registers them."""

from visitloom.plans import credit, exchange, journeys, learning, relational, retail, shelf  # noqa: F401
from visitloom.plans.registry import RUN, SQL, entry_point  # noqa: F401
