"""Part of sparkvec; see the README for the layout."""
