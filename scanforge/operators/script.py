"""The filter script: one command a line, turned into a chain of DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters

Operator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Command:
    """A keyword with the numbers of arguments it takes; build makes an operator of (arguments, scope)."""

    arity: frozenset[int]
    scoped: bool
    build: Callable[[list, str], Operator]
    help: str
    words: bool = False


COMMANDS: dict[str, Command] = {}


def command(keyword: str, *arity: int, scoped: bool = True, help: str = "", words: bool = False):
    """Register a row operator under a keyword of the script language; its arguments are numbers, or words as they stand."""

    def register(build):
        COMMANDS[keyword.upper()] = Command(frozenset(arity), scoped, build, help, words)
        return build

    return register


def tokenize(text: str) -> list[list[str]]:
    """Words of each line that is not empty; # and // start comments."""
    lines = (line.split("#", 1)[0].split("//", 1)[0].replace(",", " ").split() for line in text.splitlines())
    return [words for words in lines if words]


def parse(text: str, order: list[str] | None = None) -> list[Operator]:
    """Operators of a script; the first one makes every row valid. Unknown keywords and wrong numbers of arguments raise ValueError."""
    chain: list[Operator] = [lambda df: df.withColumn("valid", F.lit(True))]
    for words in tokenize(text):
        keyword, rest = words[0].upper(), words[1:]
        if keyword not in COMMANDS:
            raise ValueError(f"unknown command {words[0]}")
        known = COMMANDS[keyword]
        scope = rest.pop().upper() if known.scoped and rest and rest[-1].upper() in (filters.ALL, filters.VALID, filters.INVALID) else filters.ALL
        if len(rest) not in known.arity:
            raise ValueError(f"{words[0]} takes {sorted(known.arity)} arguments, not {len(rest)}")
        operator = known.build(rest if known.words else [float(v) for v in rest], scope)
        chain.append((lambda op: lambda df: op(df, order))(operator) if keyword == "DECIMATE" else operator)
    return chain


def run_script(df: DataFrame, text: str, order: list[str] | None = None) -> DataFrame:
    """Apply a script; `order` gives the arrival order of rows for Decimate (by default timestamp and all coordinates)."""
    for operator in parse(text, order or ["timestamp", "index", "x", "y", "z"]):
        df = df.transform(operator)
    return df


@command("FlipValid", 0, help="exchange valid and invalid rows")
def _flip(a, scope):
    return lambda df: filters.flip_valid(df, scope)


@command("Kill", 0, help="drop rows")
def _kill(a, scope):
    return lambda df: filters.kill(df, scope)


@command("Decimate", 1, help="keep every n-th row")
def _decimate(a, scope):
    return lambda df, order: filters.decimate(df, int(a[0]), order, scope)


@command("PartitionPlane", 6, help="normal, point")
def _plane(a, scope):
    return lambda df: filters.partition_plane(df, a[:3], a[3:])


@command("PartitionRadius", 4, help="centre, radius")
def _radius(a, scope):
    return lambda df: filters.partition_radius(df, a[:3], a[3], scope)


@command("PartitionCylinder", 7, help="point, direction, radius")
def _cylinder(a, scope):
    return lambda df: filters.partition_cylinder(df, a[:3], a[3:6], a[6], scope)


@command("PartitionAABB", 6, help="lowest and highest x, y, z in turn")
def _box(a, scope):
    return lambda df: filters.partition_box(df, a[0::2], a[1::2], scope)


@command("Rotate", 3, 4, 9, help="Euler angles in degrees, quaternion, or matrix by rows")
def _rotate(a, scope):
    m = filters.euler_matrix(*a) if len(a) == 3 else filters.quaternion_matrix(*a, compat=True) if len(a) == 4 else [a[:3], a[3:6], a[6:]]
    return lambda df: filters.rotate(df, m, scope)


@command("Scale", 1, 3, help="factor or factors")
def _scale(a, scope):
    return lambda df: filters.scale(df, a if len(a) == 3 else a[0], scope)


@command("Translate", 1, 3, help="offset or offsets")
def _translate(a, scope):
    return lambda df: filters.translate(df, a if len(a) == 3 else a[0], scope)


@command("Recolor", 1, 3, help="grey or red, green, blue")
def _recolor(a, scope):
    return lambda df: filters.recolor(df, *map(int, a), scope=scope)


@command("Output", 1, help="write the rows in scope, as they are by now, to a folder; the format is taken from its extension", words=True)
def _output(a, scope):
    from ..sources.writers import write_points

    def run(df):
        write_points(df.where(filters.in_scope(scope)), a[0], a[0].rsplit(".", 1)[-1].lower())
        return df

    return run
