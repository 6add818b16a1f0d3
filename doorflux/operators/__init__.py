"""DataFrame-to-DataFrame operators: cleaning, quality, view, metrics, reports."""
