from tidemark.functions.calendar import (  # noqa: F401
    add_month_steps, asof_date, calendar_step, forward_window, month_start, recent_window, rolling_year_start,
)
from tidemark.functions.scalar import (  # noqa: F401
    clean_code, deepest_level, first_item, hash_unit, key_hash, stable_name, strict_flag, try_number, wide_hash_unit,
)
