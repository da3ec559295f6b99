"""Every registered query of the library with its SQL twin."""

from lectern.plans import learning, retrieval, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, text, learning):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
