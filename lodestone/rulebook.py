"""The rules that findings name."""

#: Rules in order, with what they mean (fixed order and codes).
RULES = {
    "unused-function": "A function that nothing refers to", "unused-class": "A class that nothing refers to", "unused-variable": "A module variable that nothing refers to",
    "unused-method": "A method that nothing calls by name", "unused-attribute": "An attribute that nothing reads by name", "unused-file": "A file that nothing imports or runs",
    "unused-suppression": "A suppression comment that silences nothing", "circular-import": "Modules that import each other", "complex-function": "A function that is hard to follow",
    "duplicate-code": "Code that is a copy", "boundary-violation": "An import across a declared boundary", "unused-dependency": "A dependency that nothing imports",
    "missing-dependency": "An import of an undeclared dependency", "unresolved-import": "An import that resolves to nothing",
}
