"""Column expressions (no Python UDFs): time arithmetic, calendar, statistics."""

from tsdrift.functions.timecols import (  # noqa: F401
    EPOCH, epoch_micros, from_epoch_micros, hour_number,
)
from tsdrift.functions.calendar import (  # noqa: F401
    day_of_week, is_weekend, season,
)
from tsdrift.functions.stats import (  # noqa: F401
    kolmogorov_pvalue, normal_sf, psi_severity, mape_severity,
)
