"""From text to plans: the expression language, statements and the query builder."""
