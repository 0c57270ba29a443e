"""Column functions: text, dates, numbers and territory codes. All stay inside the JVM."""

from atalaya.functions.dates import (  # noqa: F401
    month_diff, month_index, month_start, parse_dates, period_str,
)
from atalaya.functions.numbers import (  # noqa: F401
    fmt_pct, fmt_thousands, number, parse_coord, parse_quantity, to_count, to_rate,
)
from atalaya.functions.territory import (  # noqa: F401
    blank_to, nature, region, region_name, stage_class, stage_order, territory_code,
)
from atalaya.functions.text import (  # noqa: F401
    ascii_fold, category_canon, norm_text, strip_marks, unaccent_lower, words,
)
