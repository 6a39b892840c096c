"""DataFrame operators: repair, matching, joins, audits, split, balance, mining, temporal and keyed state."""
