"""Part of eigenlake."""
