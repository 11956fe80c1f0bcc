"""Analytics over content-addressed artifact catalogs, as Spark DataFrame transformations."""
