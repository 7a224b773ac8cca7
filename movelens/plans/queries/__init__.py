"""Registered queries: every operator on the driver's tables, with an SQL twin.

Two readings of the tables are used throughout.

Spells (``events``): subject = user, move = purchase, activity = click/view,
valuation = signup value, organisation = the user's nation, group = market
segment. Deals (``orders``): subject = customer, buyer = customer's nation,
seller = nation of the order's lowest-numbered supplier, fee = price in cents,
score = price in steps of 5,000.
"""

from movelens.plans.queries.base import REGISTRY, SQL, Tables  # noqa: F401
from movelens.plans.queries import browse, deals, jobs, learning, names, ranking, spells, steps  # noqa: F401
