"""Names, types, conversions and the classification of values."""
