"""aircast: indoor-climate sensor analytics as Spark DataFrame plans.

Every operator is a function ``f(df, *, keys=..., ...) -> DataFrame`` that only
builds a lazy plan; nothing is collected to the driver.  ``keys`` (default
``["room_id"]``) is the series key: all windows, aggregates and models
partition by it, and ``keys=[]`` gives the single-series behaviour back.
"""

DEFAULT_KEYS = ("room_id",)
ZONE = "Europe/Brussels"

__all__ = ["DEFAULT_KEYS", "ZONE"]
