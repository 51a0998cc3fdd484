"""Operators for preparing training corpora at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Each module holds one operator with its own general interface;
``registry`` names the queries over the driver tables.

Executors import this package too: the registered queries and the pipeline
send it along (``common.ship_package``); other callers do the same, or install it
on the cluster image.
"""
