"""Streaming.

The reference has no streaming operators (no watermark, window, state or
late data), so this package adds none.  The row-local operators of the
library — validation predicates (``operators.rules``), weather and calendar
features (``operators.features``) and payload decoding
(``sources.weather.decode_payloads``) — are plain Column expressions and
apply unchanged to a ``readStream`` DataFrame; operators that need other rows
(history windows, quality scans, aggregates) are batch jobs.
"""
