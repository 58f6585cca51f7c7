"""Settings of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class TestCollection:
    """How tests are collected: globs of file names, heads or globs of class and function names."""

    __test__ = False
    files: tuple[str, ...] = ("test_*.py", "*_test.py", "tests.py")
    classes: tuple[str, ...] = ("Test",)
    functions: tuple[str, ...] = ("test",)


@dataclass
class DenyRule:
    source: str
    deny: tuple[str, ...]
    allow: tuple[str, ...] = ()


@dataclass
class Boundaries:
    """Layers from the top down, each a tuple of module prefixes, and rules of what may not import what."""

    layers: tuple[tuple[str, ...], ...] = ()
    rules: tuple[DenyRule, ...] = ()
    check_type_only: bool = False

    @classmethod
    def hexagonal(cls, root: str) -> Boundaries:
        """What faces outwards on top, services below it, the domain at the bottom."""
        ranks = (("adapters", "api", "infrastructure", "infra"), ("application", "services"), ("domain",))
        return cls(layers=tuple(tuple(f"{root}.{name}" for name in rank) for rank in ranks))


@dataclass
class Limits:
    cyclomatic: int = 10
    cognitive: int = 15
    lines: int = 50
    parameters: int = 5


@dataclass
class Config:
    exclude: tuple[str, ...] = ()
    ignore_names: tuple[str, ...] = ()
    public_modules: tuple[str, ...] = ()
    library_packages: tuple[str, ...] = ()
    ignored_dependencies: tuple[str, ...] = ()
    plugins: bool = True
    notebooks: bool = False
    marker: str = "lodestone"
    tests: TestCollection = field(default_factory=TestCollection)
    boundaries: Boundaries | None = None
    limits: Limits = field(default_factory=Limits)
