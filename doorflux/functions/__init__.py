"""Column expressions: text and number coercion, rounding, periods, labels."""
