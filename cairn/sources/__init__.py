"""Tables, version log and adapters of input data."""
