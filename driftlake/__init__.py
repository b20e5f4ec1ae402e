"""Analytics on (client, step) grids and text corpora as DataFrame plans."""
