"""Training-data operators: packing, decontamination, licences, quality, language, dedup, chat, PII.

Nothing outside this package imports it.  ``registry`` lists its queries.
"""
