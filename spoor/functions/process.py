"""Command lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spoor.functions.paths import basename

#: What downloads, what runs what it reads, and the shells.
DOWNLOADERS = ["curl", "wget", "fetch"]
INTERPRETERS = ["sh", "bash", "dash", "zsh", "python", "python3", "perl", "ruby", "node"]
SHELLS = ["sh", "bash", "dash", "zsh", "ksh"]
PIPELINE_TOOLS = ["curl", "wget", "fetch", "aria2c"]
RUNNERS = ["sh", "bash", "dash", "zsh", "ksh", "python", "python3", "perl", "ruby", "node"]


def contains_word(text: Column, word: str) -> Column:
    return F.array_contains(F.split(text, "[^A-Za-z0-9_-]", -1), word)


def command_line(argv: Column, program: Column) -> Column:
    return F.when(F.size(argv) > 0, F.array_join(argv, " ")).otherwise(F.coalesce(program, F.lit("")))


def pipes_download_to_shell(argv: Column, truncated: Column) -> Column:
    """A whole command of a shell, -c and a script that hands a download to an interpreter."""
    script = F.get(argv, F.array_position(argv, "-c").cast("int"))  # the argument after the first -c
    downloads = F.exists(F.split(script, "[^A-Za-z0-9_-]", -1), lambda w: w.isin(DOWNLOADERS))

    def runs(segment: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.trim(segment), "^(sudo )+", ""))
        return bare.rlike("^(" + "|".join(INTERPRETERS) + ")")

    segments = F.split(script, "\\|", -1)
    piped = F.exists(F.slice(segments, 2, F.size(segments)), runs)
    shell = basename(F.get(argv, F.lit(0))).isin(SHELLS)
    return F.coalesce(~truncated & (F.size(argv) >= 3) & shell & (F.array_position(argv, "-c") > 0) & downloads & piped, F.lit(False))


def shell_pipeline_tool(argv: Column) -> Column:
    """The first download tool before the first pipe, if a shell or interpreter comes after it."""
    joined = F.array_join(argv, " ")
    before = F.split(F.substring_index(joined, "|", 1), "[^A-Za-z0-9_-]", -1)
    after = F.split(F.substring(joined, F.char_length(F.substring_index(joined, "|", 1)) + 2, F.char_length(joined)), "[^A-Za-z0-9_-]", -1)
    tool = F.get(F.filter(F.array(*map(F.lit, PIPELINE_TOOLS)), lambda t: F.array_contains(before, t)), F.lit(0))
    shells = F.exists(after, lambda w: w.isin(RUNNERS))
    return F.when(joined.contains("|") & shells, tool)


def truncate_subject(text: Column) -> Column:
    """At most 200 bytes whole; longer ones as their first 200 characters and an ellipsis."""
    return F.when(F.octet_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("…"))).otherwise(text)
