"""Jobs that build the layers, and the reports on top of them."""
