"""Flow: lazy, composable operators over a DataFrame with a tracked order.

Sequential and parallel sequences are one type: an ordered flow has order keys, an
unordered one has none.  Operators that are defined by order need an ordered flow;
take, skip and searches on an unordered one mean any elements.  Nothing runs until
a sink or a value is asked for, and Catalyst plans the whole chain.
"""

from __future__ import annotations

from .operators.aggregate import Aggregate
from .operators.combine import Combine
from .operators.custom import Custom
from .operators.keyed import Keyed
from .operators.positional import Positional
from .operators.search import Search
from .operators.sinks import Sinks
from .linq import Linq


class Flow(Linq, Search, Combine, Keyed, Positional, Custom, Sinks, Aggregate):
    """All operators on one type."""
