"""Tools, catalog and registered queries."""
