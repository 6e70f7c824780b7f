"""Training-data pipeline operators (deduplication, filtering, packing, WARC).

Nothing else in the package imports this subpackage.  Each module holds one
operator; ``queries`` registers them for the driver.  Operators take a
DataFrame with ``doc_id``/``text`` (or ``page_id``/``url``/``html``) and select
the columns they need, so extra columns never clash.
"""
