"""tessera: grounded retrieval and answer assembly as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (use it with
``DataFrame.transform``) or a ``Column`` expression. What reaches the driver has a
stated bound: counts, a query matrix of at most ``max_query_bytes``, the centroids,
codebooks and calibration queries of an index.
"""

from tessera.config import RetrievalConfig

__all__ = ["RetrievalConfig"]
