"""Reading recordings and writing results."""
