"""Column functions whose exact semantics the queries rest on."""
