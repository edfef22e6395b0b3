"""Market queries over canonical transactions: each a lazy plan, fn(tx, **parameters) -> DataFrame."""
