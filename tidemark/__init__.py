"""Analytics over irregularly sampled per-entity series, as Spark plans."""
