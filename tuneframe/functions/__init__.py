"""Column-level functions: each takes Columns and returns a Column."""

from tuneframe.functions.text import *  # noqa: F401,F403
from tuneframe.functions.paths import *  # noqa: F401,F403
from tuneframe.functions.jsonl import *  # noqa: F401,F403
from tuneframe.functions.render import *  # noqa: F401,F403
from tuneframe.functions.numeric import *  # noqa: F401,F403
from tuneframe.functions.tokens import *  # noqa: F401,F403
