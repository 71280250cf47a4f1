"""tablescout: geo-semantic recommendation analytics as Spark jobs.

Whole tables of diner requests are answered against a catalog of places:
box, rating and price filters, great-circle distance, vector similarity and a
blended top-k per request, plus ingestion, embedding backfill, text rendering,
grounding of generated texts, the interaction log and quality evaluation.
"""

import sys

from pyspark import cloudpickle

# The Arrow kernels travel inside the task closures, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
