"""Column -> Column building blocks (scalar functions, hexagonal cells)."""

from .columns import (  # noqa: F401
    col, strict_cast, money_from_text, exact_avg, yes_flag, is_present,
    date_from_parts, pct, period_label, default_to, density_class,
    parse_yyyymmdd, month_of, month_start, lenient_number, daily_hours,
)
from .hexgrid import (  # noqa: F401
    hex_centroid, hex_boundary, with_hex_cell,
)
