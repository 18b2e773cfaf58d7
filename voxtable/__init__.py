"""voxtable: customer-feedback text tables on Spark.

Column functions live in ``voxtable.functions``, table operators in
``voxtable.operators``, readers and writers in ``voxtable.sources``, whole jobs in
``voxtable.plans`` and the streaming wrappers in ``voxtable.streaming``.
"""

__version__ = "0.1.0"
