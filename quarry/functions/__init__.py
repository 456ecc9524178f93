"""Part of the quarry engine; see the README for the layout."""
