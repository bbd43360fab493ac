"""Rule-regex dialect -> java.util.regex, rewritten once per pattern on the driver.

Rule files are written for a Rust-``regex``-style dialect (RE2 family):
``$`` is end of text only, ``.`` excludes only ``\\n``, ``(?P<name>..)``
names groups, and there is no look-around or back-reference.  Spark's
``RLIKE`` uses java.util.regex, so the few differences are rewritten here.
"""

from __future__ import annotations

import re


_POSIX_CLASS = re.compile(r"\[:(\^?)([a-z]+):\]")
# POSIX class names and what java.util.regex calls them
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


class PatternError(ValueError):
    """A rule or ignore pattern that does not compile."""


def to_java_regex(pattern: str) -> str:
    """Rewrite one pattern; raise PatternError for constructs outside the dialect."""
    out: list[str] = []
    i = 0
    n = len(pattern)
    in_class = False
    while i < n:
        ch = pattern[i]
        if ch == "\\":
            if i + 1 >= n:
                raise PatternError(f"trailing backslash in {pattern!r}")
            nxt = pattern[i + 1]
            if not in_class and nxt.isdigit() and nxt != "0":
                raise PatternError(f"back-references are not supported: {pattern!r}")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            posix = _POSIX_CLASS.match(pattern, i)
            if posix:
                java = _POSIX.get(posix[2])
                if java is None:
                    raise PatternError(f"unknown class {posix[0]} in {pattern!r}")
                out.append(("\\P" if posix[1] else "\\p") + "{" + java + "}")
                i = posix.end()
                continue
            if ch == "[":
                # a nested '[' inside a class is literal in RE2; Java would open a union
                out.append("\\[")
            else:
                if ch == "]" and not (out and out[-1] in ("[", "[^")):
                    in_class = False
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            if pattern.startswith("[^", i):
                out.append("[^")
                i += 2
            else:
                out.append("[")
                i += 1
            # a leading ']' is a literal member
            if i < n and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if ch == "$":
            out.append("\\z")
            i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?=", i) or pattern.startswith("(?!", i) or pattern.startswith("(?<=", i) or pattern.startswith("(?<!", i):
            raise PatternError(f"look-around is not supported: {pattern!r}")
        m = re.match(r"\(\?([a-zA-Z-]+)[:)]", pattern[i:])
        if m and "U" in m.group(1):
            raise PatternError(f"the swap-greed flag is not supported: {pattern!r}")
        out.append(ch)
        i += 1
    if in_class:
        raise PatternError(f"unclosed character class in {pattern!r}")
    # UNIX_LINES: '.' excludes only '\n', like the source dialect.
    return "(?d)" + "".join(out)


def check_pattern(spark, pattern: str) -> str:
    """Rewrite and compile once on the driver (java.util.regex); return the Java form."""
    java = to_java_regex(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as exc:  # py4j wraps PatternSyntaxException
        raise PatternError(f"invalid pattern {pattern!r}: {exc}") from None
    return java


def check_pattern_local(pattern: str) -> str:
    """The Java form, compiled once by the active session's JVM; without one, by Python's ``re`` as a stand-in."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        return check_pattern(spark, pattern)
    java = to_java_regex(pattern)
    py = java[4:].replace("\\z", r"\Z").replace("(?<", "(?P<")
    try:
        re.compile(py)
    except re.error as exc:
        raise PatternError(f"invalid pattern {pattern!r}: {exc}") from None
    return java
