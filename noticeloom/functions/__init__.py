"""Column functions: text, rules, classification, field extraction."""
