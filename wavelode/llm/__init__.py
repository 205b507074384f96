"""Training-data operators: search, archives, packing, tokens, media, licences, shards, privacy, joins, toxicity.

Nothing outside this folder imports it.  Each module holds one operator with a general
interface; ``queries.py`` derives the driver's ``opN_*`` tables from them.
"""
