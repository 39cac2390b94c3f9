"""Ordered include and exclude rules over paths, compiled into one Boolean column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.functions import globs
from veldspar.functions.scalars import meta_size, meta_text

_FOLDERS = "__pycache__ bin build coverage dist node_modules obj target vendor .git .github .idea .next .pytest_cache .vscode"
_FILES = ".DS_Store .env package-lock.json yarn.lock"
_ENDINGS = "bak dll exe lock log map min.css min.js pb.go swp tmp wasm"

#: Rules where none are given: build and tool folders, generated files, locks, logs, binaries.
DEFAULT_EXCLUSIONS = [f"{x}/" for x in _FOLDERS.split()] + _FILES.split() + [f"*.{x}" for x in _ENDINGS.split()]


def parse_gitignore(text: str) -> list[str]:
    """Rules of a gitignore file, without comments and empty lines; ``git:`` marks the dialect."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            rules.append(f"!git:{line[1:]}" if line.startswith("!") else f"git:{line}")
    return rules


def as_git_rules(patterns: Iterable[str]) -> list[str]:
    """Configured patterns read as gitignore rules, keeping negation and rules already marked."""
    out = []
    for p in map(str.strip, patterns):
        sign = "!" if p.startswith("!") else ""
        p = p[len(sign) :].strip()
        if p:
            out.append(sign + (p if p.startswith("git:") else f"git:{p}"))
    return out


def plain_path(path) -> Column:
    """A location's path: scheme and authority cut, slashes forward."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def git_match(path: Column, pattern: str) -> Column:
    """Whether a gitignore rule matches a path."""
    subject = F.concat(F.regexp_replace(path, "^/", ""), F.lit("/"))
    need, rule = globs.gitignore_regex(pattern)
    hit = F.rlike(subject, F.lit(rule))
    return hit & F.rlike(subject, F.lit(need)) if need else hit


@dataclass
class PathRules:
    """Rules of one root. ``exclude=None`` means the default exclusions, an empty list means none."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] | None = None
    max_size: int = 0

    @classmethod
    def for_root(cls, include=(), exclude=(), max_size: int = 0) -> PathRules:
        """Rules as a configured root has them: defaults, then its own patterns read as gitignore rules."""
        return cls(as_git_rules(include), DEFAULT_EXCLUSIONS + as_git_rules(exclude), max_size)

    def excluded(self, path, size=None) -> Column:
        """Whether a path is excluded: too large, not included, or the last exclusion that matches isn't negated."""
        where = plain_path(path)
        out = _fold(where, DEFAULT_EXCLUSIONS if self.exclude is None else self.exclude, globs.exclusion_regex)
        if self.include:
            out = ~_fold(where, self.include, globs.inclusion_regex) | out
        if self.max_size > 0 and size is not None:
            out = (F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)) > self.max_size) | out
        return out

    def kept(self, path, size=None) -> Column:
        """The opposite of :meth:`excluded`."""
        return ~self.excluded(path, size)


def _fold(path: Column, rules: list[str], simple) -> Column:
    """Ordered rules; the last that matches decides, and none means false."""

    def step(so_far: Column, rule: str) -> Column:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            return so_far
        negated = rule.startswith("!")
        rule = rule[negated:].strip()
        if rule.startswith("git:"):
            if not rule[4:]:
                return so_far
            hit = git_match(path, rule[4:])
        elif rule:
            hit = F.rlike(path, F.lit(simple(rule)))
        else:
            return so_far
        return (so_far & ~hit) if negated else (so_far | hit)

    return reduce(step, rules, F.lit(False))


def sync_filter(rules: PathRules | None, path, meta, op) -> Column:
    """Whether a change passes: deletions always, others by their path and the size their metadata names."""
    if rules is None or not (rules.include or rules.exclude or rules.max_size):
        return F.lit(True)
    op = F.col(op) if isinstance(op, str) else op
    return (F.lower(op) == "delete") | rules.kept(path, meta_size(meta))


def listed(path, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Listing globs over the relative path and its last part; exclusions first, no inclusion means all."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(path, "/"), -1)

    def any_of(patterns) -> Column | None:
        hits = []
        for p in map(str.strip, patterns):
            if not p:
                continue
            r = F.lit(globs.list_regex(p))
            for x in (path, name):
                if "**" in p:
                    x = F.concat(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\\", "/")), r"^(?:\./)?/?", ""), "/$", ""), F.lit("/"))
                hits.append(F.rlike(x, r))
        return reduce(lambda a, b: a | b, hits) if hits else None

    yes, no = any_of(include), any_of(exclude)
    out = F.lit(True) if yes is None else yes
    return out if no is None else out & ~no


def match_path(meta) -> Column:
    """Path that a document's metadata names; empty where absent."""
    return meta_text(meta, "path")
