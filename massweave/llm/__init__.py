"""Training-data operators: packing, quality, privacy, language, WARC, joins, HTML, media, pieces, toxicity, variants, counts, resampling.

Nothing else in the library imports this subpackage.
"""
