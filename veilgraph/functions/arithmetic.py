"""Column expressions for padded sizes, parallelism and hashing of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Padding tiers (rows below the bound, share of dummies) and the
# share beyond the last tier; worker counts by result size.
PAD_TIERS = ((1000, 0.20), (5000, 0.15))
PAD_BEYOND = 0.10
WORKER_TIERS = ((500, 1), (2000, 2), (5000, 4))
WORKERS_BEYOND = 8
BENCH_WORKERS = (1, 2, 4)


def _tiered(r: Column, tiers, beyond) -> Column:
    (bound, value), *rest = tiers
    expr = F.when(r < bound, F.lit(value))
    for bound, value in rest:
        expr = expr.when(r < bound, F.lit(value))
    return expr.otherwise(F.lit(beyond))


def padded_size(r: Column) -> Column:
    """Adaptive padding: at least one dummy, a smaller share for larger results; 0 stays 0."""
    extra = F.ceil(r.cast("double") * _tiered(r, PAD_TIERS, PAD_BEYOND)).cast("bigint")
    return F.when(r == 0, F.lit(0).cast("bigint")).otherwise(
        r.cast("bigint") + F.greatest(F.lit(1).cast("bigint"), extra)
    )


def doubled_size(r: Column) -> Column:
    """Fixed padding: twice the true size."""
    return r.cast("bigint") * 2


def workers_for(r: Column) -> Column:
    """Degree of parallelism by result size."""
    return _tiered(r, WORKER_TIERS, WORKERS_BEYOND).cast("bigint")


def bench_worker_counts(r: Column) -> Column:
    """The worker counts measured for a result size: 1, 2, 4 and its own, up to its own."""
    own = workers_for(r)
    candidates = F.array(*[F.lit(k).cast("bigint") for k in BENCH_WORKERS], own)
    return F.array_sort(F.array_distinct(F.filter(candidates, lambda k: k <= own)))


def shard_size(p_r: Column, k: Column) -> Column:
    """Rows per worker when ``p_r`` rows are split over ``k`` workers."""
    return F.ceil(p_r / k).cast("bigint")


def spread(x: Column) -> Column:
    """Scatter integer ids evenly; plain arithmetic, so any SQL engine gives the same value.

    Ids that agree modulo the prime differ in their quotient, which is mixed in.
    """
    prime = F.lit(2147483647).cast("bigint")
    quotient = F.call_function("div", x, prime)
    return F.pmod(F.pmod(x, prime) * 48271 + F.pmod(quotient * 16807, prime), prime)


def to_base36(number: Column) -> Column:
    """A bigint in few characters; its bits are taken as they are, so a negative one has the most."""
    return F.conv(F.hex(number.cast("bigint")), 16, 36)


def from_base36(text: Column) -> Column:
    """The bigint that ``to_base36`` wrote, NULL for no text."""
    return F.conv(text, 36, -10).try_cast("bigint")


def piece_count(degree: Column, rows: int) -> Column:
    """Into how many pieces a neighbour list of ``degree`` entries is cut."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(degree / rows).cast("bigint"))
