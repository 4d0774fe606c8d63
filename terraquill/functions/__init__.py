"""Part of terraquill."""
