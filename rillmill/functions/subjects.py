"""Subjects and wildcard patterns: tokens parted by dots, ``*`` for one token, ``>`` at the end for one or more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_subject(s: Column) -> Column:
    """No empty token, no white space and no wildcard."""
    return F.coalesce(s.rlike(r"^[^.*>\s]+(?:\.[^.*>\s]+)*$"), F.lit(False))


def valid_pattern(p: Column) -> Column:
    """As a subject, but a token may be ``*``, and the last one ``>``; a wildcard is a token of its own."""
    return F.coalesce(p.rlike(r"^(?:>|(?:\*|[^.*>\s]+)(?:\.(?:\*|[^.*>\s]+))*(?:\.>)?)$"), F.lit(False))


def matches(subject: Column, pattern: Column) -> Column:
    """Whether the pattern takes the subject in."""
    return _overlap(F.split(subject, r"\."), F.split(pattern, r"\."))


def collide(a: Column, b: Column) -> Column:
    """Whether some subject matches both patterns."""
    return _overlap(F.split(a, r"\."), F.split(b, r"\."))


def _overlap(a: Column, b: Column) -> Column:
    open_a, open_b = F.element_at(a, -1) == ">", F.element_at(b, -1) == ">"
    na, nb = F.size(a), F.size(b)
    # a tail stands for one token or more, so the shorter list may end before the other only by its tail
    long_enough = F.when(open_a & open_b, True).when(open_a, nb >= na).when(open_b, na >= nb).otherwise(na == nb)
    fixed = F.least(na - open_a.cast("int"), nb - open_b.cast("int"))
    pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), F.greatest(fixed, F.lit(0)))
    return long_enough & F.forall(pairs, lambda p: (p["x"] == p["y"]) | (p["x"] == "*") | (p["y"] == "*"))


def covers(wide: Column, narrow: Column) -> Column:
    """Whether every subject that ``narrow`` matches is matched by ``wide``: what a search for patterns by a pattern looks for."""
    w, n = F.split(wide, r"\."), F.split(narrow, r"\.")
    open_w, open_n = F.element_at(w, -1) == ">", F.element_at(n, -1) == ">"
    enough = F.when(open_w, F.size(n) >= F.size(w)).otherwise((F.size(w) == F.size(n)) & ~open_n)
    pairs = F.slice(F.arrays_zip(w.alias("w"), n.alias("n")), F.lit(1), F.greatest(F.size(w) - open_w.cast("int"), F.lit(0)))
    one = lambda p: (p["w"] == p["n"]) | ((p["w"] == "*") & (p["n"] != ">"))
    return enough & F.forall(pairs, one)
