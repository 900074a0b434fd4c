"""Column functions: geometry, sun, climate, money and text."""
