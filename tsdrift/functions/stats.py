"""Statistical column expressions: severities, Kolmogorov p-value, normal tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsdrift.config import PSI_STABLE_BELOW, PSI_WARNING_BELOW

KOLMOGOROV_TERMS = 100
KOLMOGOROV_SMALL_LAMBDA = 0.2  # below this the limit distribution is 1 to double precision


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def psi_severity(psi) -> Column:
    p = _c(psi)
    return (F.when(p < PSI_STABLE_BELOW, "stable")
            .when(p < PSI_WARNING_BELOW, "warning")
            .when(p.isNotNull(), "critical"))


def mape_severity(ratio, alpha, beta) -> Column:
    r = _c(ratio)
    return (F.when(r >= F.lit(beta), "critical")
            .when(r >= F.lit(alpha), "warning")
            .when(r.isNotNull(), "stable"))


def kolmogorov_pvalue(d, n, m) -> Column:
    """Two-sided asymptotic p-value of the two-sample KS statistic.

    Q(lambda) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), lambda =
    sqrt(n m / (n + m)) * D, clamped to [0, 1]; 1.0 for tiny lambda where the
    truncated series is not yet accurate.
    """
    d, n, m = _c(d), _c(n).cast("double"), _c(m).cast("double")
    lam = F.sqrt(n * m / (n + m)) * d
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    series = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))
    return F.when(lam < KOLMOGOROV_SMALL_LAMBDA, F.lit(1.0)).otherwise(clamped)


def normal_sf(z) -> Column:
    """Upper tail P(Z > z) of the standard normal, via the complementary error
    function approximation erfc(x) with fractional error below 1.2e-7 (the
    rational Chebyshev fit published in Numerical Recipes, section 6.2)."""
    x = F.abs(_c(z)) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(0.17087277)
    for coef in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806,
                 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(coef) + t * poly
    erfc = t * F.exp(-x * x + poly)
    upper = F.lit(0.5) * erfc
    return F.when(_c(z) >= 0, upper).otherwise(F.lit(1.0) - upper)
