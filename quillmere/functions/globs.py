"""Glob patterns and ignore rules, compiled on the driver to regular expressions for rlike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is always ignored.
BUILT_IN = (
    ".vault/", ".vaultignore", ".md/", ".mdignore", ".crawl/", ".crawlignore", ".git/", ".gitignore", ".svn/", ".hg/",
    "node_modules/", "__pycache__/", ".DS_Store", "Thumbs.db", "desktop.ini", "*.pyc", ".idea/", ".vscode/",
)


def glob_regex(pattern: str) -> str | None:
    """An anchored expression; * and ? also match /, ** only stands as a whole component. None for an invalid pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            whole = (i == 0 or pattern[i - 1] == "/") and (i + 2 == len(pattern) or pattern[i + 2] == "/")
            if not whole:
                return None
            if i + 2 < len(pattern):
                out, i = out + "(?:.*/)?", i + 3
            else:
                out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))
            if end < 0:
                return None
            inner = pattern[i + 1 : end]
            negate, inner = inner.startswith("!"), inner.removeprefix("!")
            out += f"[{'^' * negate}{re.sub(r'([\\\\\[\]^&])', r'\\\1', inner)}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else path.rlike(regex)


def path_ok(rel_path: Column, name: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path or name passes: exclusion wins, no inclusions means all, invalid patterns don't count."""
    def any_of(patterns):
        out = F.lit(False)
        for p in patterns:
            if glob_regex(p) is not None:
                out = out | F.coalesce(glob_match(rel_path, p), F.lit(False)) | F.coalesce(glob_match(name, p), F.lit(False))
        return out

    return ~any_of(exclude) & (any_of(include) if any(glob_regex(p) for p in include) else F.lit(True))


def ext_ok(ext: Column, include: list[str], exclude: list[str]) -> Column:
    e = F.lower(ext)
    wanted = e.isin([x.lower() for x in include]) if include else F.lit(True)
    return F.coalesce(~e.isin([x.lower() for x in exclude]) & wanted if exclude else wanted, F.lit(not include))


#: Follow a level of a path in what ignore_regex() reads. What it leaves of them tells whether the last rule that fits ignores.
MARKS = "\x00\x01"  # no path holds the first


def rule_body(line: str) -> tuple[str, bool] | None:
    """(expression, negated) of a line of an ignore file, for a level of a path: a file's path, or a folder's with a / at its end.
    None for a comment, an empty line or an invalid pattern. * ? and [] stay within a component, ** as a whole component
    stands for any number of them, a \\ takes the next character as it is."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negate, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.removesuffix("/")
    rooted, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    parts = line.split("/")
    out = "" if rooted else "(?:[^\x00]*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "[^/\x00][^\x00]*" if last else "(?:[^\x00]*/)?"
            continue
        at = 0
        while at < len(part):
            c = part[at]
            if c == "\\":
                if at + 1 == len(part):
                    return None
                out += re.escape(part[at + 1])
                at += 1
            elif c == "*":
                out += "" if part[at - 1 : at] == "*" else "[^/\x00]*"
            elif c == "?":
                out += "[^/\x00]"
            elif c == "[":
                end = part.find("]", at + 2 + (part[at + 1 : at + 2] in ("!", "^")))
                if end < 0:
                    return None
                inner = part[at + 1 : end]
                negated, inner = inner[0] in "!^", inner.lstrip("!^") if inner[0] in "!^" else inner
                out += f"(?![/\x00])[{'^' * negated}{re.sub(r'([\\\[\]^&~|])', r'\\\1', inner)}]"
                at = end
            else:
                out += re.escape(c)
            at += 1
        out += "" if last else "/"
    return out + ("/" if folder else "/?"), negate


def ignore_regex(lines=(), built_in: bool = True) -> str:
    """One expression for all rules, over a level followed by MARKS. Its alternatives are tried from the last rule on, so the first
    that fits is the rule that decides; one that negates takes the first mark, so the group tells which kind it was."""
    rules = [r for line in [*(BUILT_IN if built_in else ()), *lines] if (r := rule_body(line))]
    return f"(?s)^(?:{'|'.join(body + MARKS[0] * negate for body, negate in reversed(rules)) or '(?!)'})({MARKS[0]}?{MARKS[1]})$"


def ignored(path: Column, lines=(), built_in: bool = True) -> Column:
    """Whether a relative file path is ignored. The file and then each folder above it is a level; the deepest level that a rule
    fits decides, by the last rule that fits it. Each level is read once, however many rules there are."""
    parts, regex = F.split(path, "/"), ignore_regex(lines, built_in)
    levels = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), "/").otherwise("")))
    said = F.filter(F.transform(levels, lambda x: F.regexp_extract(F.concat(x, F.lit(MARKS)), regex, 1)), lambda x: x != "")
    return F.coalesce(F.get(said, F.lit(0)) == MARKS, F.lit(False))


class Ignorer:
    """ignored() for one path at a time, in tasks that walk folders."""

    def __init__(self, lines=(), built_in: bool = True) -> None:
        self.regex = re.compile(ignore_regex(lines, built_in))

    def __call__(self, path: str, folder: bool = False) -> bool:
        level = path + "/" * folder
        while level:
            if m := self.regex.match(level + MARKS):
                return m[1] == MARKS
            above = level.removesuffix("/").rpartition("/")
            level = above[0] + above[1]
        return False
