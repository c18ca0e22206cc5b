"""Training-data operators; everything here is optional for the rest of the library."""
