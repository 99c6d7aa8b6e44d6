"""encore: listening-affinity analytics as Spark DataFrame operators.

Play events -> per-artist behavioural features -> log/min-max scaled
superfan score -> distributed global rank -> blend with ranked-list
recency signals -> top artists -> event-catalogue match -> HTML digest.

Every public function takes and returns DataFrames, takes column names
as parameters and an optional ``scope`` list (e.g. ``["user_id"]``)
that prefixes every grouping, partitioning and scaling key, so the same
code serves one listener or millions at once.
"""

from encore.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
