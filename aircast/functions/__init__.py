"""Column functions (calendar, scalar, text).  All built-in expressions:
they stay inside whole-stage codegen."""
