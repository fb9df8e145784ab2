from . import bookings, calls, cohorts, couriers, customers, deliveries, issues, nps, pickups, quantiles, skew

__all__ = [
    "bookings", "calls", "cohorts", "couriers", "customers", "deliveries",
    "issues", "nps", "pickups", "quantiles", "skew",
]
