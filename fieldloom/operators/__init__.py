"""DataFrame-to-DataFrame operators, keyed by site or sensor."""
