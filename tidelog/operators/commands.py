"""Commands: their words, base command and the track their output takes."""

from __future__ import annotations

import shlex
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The commands of each track.
OPERATORS = ("&&", "||", ";", "|")
WRAPPERS = ("sudo", "uv", "run", "npx", "poetry", "python", "python3", "py")
PYTHONS = ("python", "python3", "py")
LOSSLESS = (
    "git status", "git stash list", "cargo test", "cargo build", "cargo check", "go test", "pip install", "docker ps", "docker images", "tsc",
    "eslint", "ruff check", "mypy", "cargo clippy", "gh", "aws", "kubectl get pods", "pnpm list", "npm list",
)
FAST = ("ls", "find", "grep")
PASSTHROUGH = (
    "cat ", "head ", "tail ", "sed ", "awk ", "git diff ", "git show ", "git log ", "curl ", "wget ", "ping ", "ip ", "ifconfig ", "netstat ",
    "Test-NetConnection ", "tnc ", "df ", "du ", "free ", "whoami ", "hostname ", "dir ", "Get-ChildItem ", "New-Item ", "fd ", "git ls-files ",
)
DAEMONS = ("uvicorn", "vite", "next", "flask", "http.server", "runserver", "vim", "nano", "top", "htop", "less", "more", "man")


LISTS = {"lossless": LOSSLESS, "fast": FAST, "passthrough": PASSTHROUGH, "daemons": DAEMONS}


def read_lists(path: str) -> dict[str, tuple[str, ...]]:
    """The tracks' commands from a TOML file with lists of these names; those it lacks are as above."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    if unknown := set(found) - set(LISTS):
        raise ValueError(f"unknown lists: {sorted(unknown)}")
    return LISTS | {name: tuple(map(str, values)) for name, values in found.items()}


@F.pandas_udf(ArrayType(StringType()))
def words(command: pd.Series) -> pd.Series:
    """Words of a command by the rules of a POSIX shell; null where quotes do not close or the command is null."""

    def split(x: str | None) -> list[str] | None:
        try:
            return None if x is None else shlex.split(x)
        except ValueError:
            return None

    return command.map(split)


def _starts(command: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(F.regexp_replace(command, r"(?U)^\s+", ""))
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p.lower())
    return out


def _has(arr: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(arr, F.array(*map(F.lit, values)))


def _name(word: Column) -> Column:
    return F.regexp_replace(word, r"^.*[/\\]", "")


def is_passthrough(command: Column, prefixes: tuple[str, ...] = PASSTHROUGH) -> Column:
    return _starts(command, prefixes)


def is_compound(parts: Column) -> Column:
    """Whether an operator stands among the words; a command that cannot be split counts as one."""
    return F.coalesce(_has(parts, OPERATORS), F.lit(True))


def base(parts: Column) -> Column:
    """The first word that is no setting and no wrapper, without its folder, in lower case."""
    names = F.transform(F.filter(parts, lambda w: ~(F.contains(w, F.lit("=")) & ~w.startswith("-"))), _name)
    first = F.get(F.filter(names, lambda w: ~w.isin(*WRAPPERS)), F.lit(0))
    return F.when(parts.isNull(), F.lit("unknown")).when(is_compound(parts), F.lit("compound_command")).otherwise(F.coalesce(F.lower(first), F.lit("unknown")))


def is_inline_python(parts: Column) -> Column:
    """Whether a Python is called with ``-c``."""
    hits = F.transform(parts, lambda w, i: F.lower(_name(w)).isin(*PYTHONS) & F.coalesce(F.get(parts, i + 1) == "-c", F.lit(False)))
    return F.coalesce(F.exists(hits, lambda x: x), F.lit(False))


def classify(
    commands: DataFrame, command: str = "command", shell: Column | None = None,
    lossless: tuple[str, ...] = LOSSLESS, fast: tuple[str, ...] = FAST, passthrough: tuple[str, ...] = PASSTHROUGH, daemons: tuple[str, ...] = DAEMONS,
) -> DataFrame:
    """``commands`` with ``base`` and ``track``. Null commands have neither; ``shell`` says which ran in a shell."""
    parts, cmd = F.col("_words"), F.col(command)
    low = F.lower(F.regexp_replace(cmd, r"(?U)^\s+", ""))
    b = F.col("_base")
    daemon = b.isin(*[d.lower() for d in daemons]) | _has(F.transform(parts, F.lower), tuple(d.lower() for d in daemons))
    daemon = daemon | (F.array_contains(F.transform(parts, F.lower), "npm") & F.contains(low, F.lit("run dev")))
    daemon = daemon | ((b == "django-admin") & F.contains(low, F.lit("runserver"))) | ((b == "python") & F.contains(low, F.lit("http.server"))) | ((b == "next") & F.contains(low, F.lit(" dev")))
    is_lossless = _starts(cmd, lossless) | b.isin(*{x.split()[0] for x in lossless})
    in_shell = F.lit(False) if shell is None else F.coalesce(shell, F.lit(False))
    track = (
        F.when(cmd.isNull(), F.lit(None).cast("string")).when(is_compound(parts), "full_pipe").when(is_passthrough(cmd, passthrough) | is_inline_python(parts), "passthrough")
        .when(daemon, "daemon_warn").when((b == "pytest") | low.startswith("pytest "), "pytest_native")
        .when(is_lossless & ~in_shell, "rtk_lossless").when(b.isin(*fast) & ~in_shell & ~is_lossless, "rtk_fast").otherwise("full_pipe")
    )
    split = commands.withColumn("_words", words(cmd)).withColumn("_base", base(parts))
    return split.withColumn("base", F.when(cmd.isNotNull(), b)).withColumn("track", track).drop("_words", "_base")
