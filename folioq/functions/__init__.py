"""Functions of the expression language, as Column builders."""
