"""Plan inspection helpers and the dashboard filter-state composition."""
