"""Outlines: flattening of path strings, distances, placement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Straight pieces of one curve.
STEPS = 10
#: Numbers that each command of the path grammar takes; small letters are relative to the current point.
_TAKES = {"m": 2, "l": 2, "h": 1, "v": 1, "q": 4, "c": 6, "z": 0}
_COMMANDS = re.compile(r"([A-Za-z])([^A-Za-z]*(?:[eE][-+]?[0-9][^A-Za-z]*)*)")
_NUMBERS = re.compile(r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")

Point = tuple[float, float]


def _commands(path: str) -> Iterator[tuple[str, list[float]]]:
    """Each command with one set of its numbers; a letter followed by several sets is repeated, a move as lines."""
    for letter, rest in _COMMANDS.findall(path):
        takes = _TAKES.get(letter.lower())
        if takes is None:
            continue
        if not takes:
            yield letter, []
            continue
        numbers = [float(n) for n in _NUMBERS.findall(rest)]
        for i in range(0, len(numbers) - takes + 1, takes):
            yield letter, numbers[i : i + takes]
            letter = {"M": "L", "m": "l"}.get(letter, letter)


def flatten(path: str) -> list[list[Point]]:
    """Polylines of a path of M, L, H, V, Q, C and Z commands, absolute or relative; curves become STEPS straight pieces.

    A part of a single point draws nothing and is left out; sets of too few numbers are passed over."""
    out: list[list[Point]] = []
    x = y = 0.0
    for letter, v in _commands(path or ""):
        kind, relative = letter.lower(), letter.islower()
        base = (x, y) if relative else (0.0, 0.0)
        if kind == "z":
            if out:
                x, y = out[-1][0]
                out[-1].append((x, y))
                out.append([(x, y)])  # what follows starts anew from there
            continue
        if kind in "hv":
            knots = [(base[0] + v[0], y) if kind == "h" else (x, base[1] + v[0])]
        else:
            knots = [(base[0] + a, base[1] + b) for a, b in zip(v[::2], v[1::2], strict=True)]
        if kind == "m" or not out:
            out.append([knots[-1]] if kind == "m" else [(x, y)])
        if kind in "qc":
            out[-1] += [_bezier([(x, y), *knots], i / STEPS) for i in range(1, STEPS + 1)]
        elif kind != "m":
            out[-1] += knots
        x, y = out[-1][-1]
    return [line for line in out if len(line) > 1]


def _bezier(knots: list[Point], t: float) -> Point:
    while len(knots) > 1:
        knots = [((1 - t) * a + t * c, (1 - t) * b + t * d) for (a, b), (c, d) in zip(knots, knots[1:], strict=False)]
    return knots[0]


def flattened(path: Column) -> Column:
    """array<array<struct<x, y>>> of a path column, by an Arrow function."""

    @F.pandas_udf("array<array<struct<x:double,y:double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: [[{"x": x, "y": y} for x, y in line] for line in flatten(p)])

    return run(path)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a straight piece."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(F.lit(0.0))
    return F.hypot(px - x1 - t * dx, py - y1 - t * dy)


def placed(x: Column, y: Column, scale: Column, degrees: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point scaled, turned and moved."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return scale * (x * c - y * s) + dx, scale * (x * s + y * c) + dy


def over(top: Column, alpha: Column, below: Column) -> Column:
    """A colour value laid over another with an opacity of 0 to 255."""
    return F.round((top * alpha + below * (255 - alpha)) / 255).cast("int")
