"""Training-data operators: decontamination, archives, near-duplicates, repeats,
sharding, licence scans, tokenisation and document classifiers.

Nothing else in the library imports this subpackage. ``queries.load()`` gives
the registered queries, ``corpus_pipeline.py`` chains five of the operators.
"""
