"""Imports every query module so that the registry is complete."""

from . import readings  # noqa: F401
from . import daily_tables  # noqa: F401,E402
from . import trend_tables  # noqa: F401,E402
from . import store_tables  # noqa: F401,E402
from . import prompt_tables  # noqa: F401,E402
from . import model_tables  # noqa: F401,E402
from . import stream_tables  # noqa: F401,E402
from . import served_tables  # noqa: F401,E402
from . import branch_tables  # noqa: F401,E402
