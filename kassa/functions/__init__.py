"""Column-level helpers. All return native Spark Columns (no Python UDFs)."""
from kassa.functions.calendar import *  # noqa: F401,F403
from kassa.functions.amounts import *  # noqa: F401,F403
from kassa.functions.text import *  # noqa: F401,F403
from kassa.functions.formatting import *  # noqa: F401,F403
