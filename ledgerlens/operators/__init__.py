"""DataFrame -> DataFrame operators (joins, aggregates, keys, collapse)."""

from .relational import (  # noqa: F401
    join_on, null_safe_join, full_outer_using, select_renamed, all_but, drop_incomplete, in_lists, in_frame,
)
from .aggregates import n_unique, count_true, top_k, distinct_values, category_share  # noqa: F401
from .categories import (  # noqa: F401
    collapse_rare, frequent_values, frequent_keys, fill_missing, map_rare, max_frequent,
    CATEGORY_THRESHOLD, OTHER, MISSING,
)
from .heavy import frequent_values_bounded  # noqa: F401
from .keys import extend_keys, surrogate_key  # noqa: F401
from .distinct import distinct_bitmaps, merge_bitmaps, count_bitmaps  # noqa: F401
