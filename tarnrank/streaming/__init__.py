"""The surface covered here is batch only: there is no streaming source, window or state to offer.

Operators are DataFrame to DataFrame, so stateless ones (centring against fixed means, scoring with a
fitted factor model) run unchanged on a streaming frame.
"""
