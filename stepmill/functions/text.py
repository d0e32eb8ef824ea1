"""Column functions for names, calls, patches and bounded texts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepmill.functions.dims import ALIASES, EMPTY_PATCHES, TOOLS


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def safe_name(c: Column) -> Column:
    """File-safe identifier; NULL where nothing usable is left."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")
    return F.when(~s.isin("", ".", ".."), s)


def repo_slug(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("__"))


def normal_name(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def action_name(action: Column) -> Column:
    """Text before the first parenthesis, trimmed, in lower case; NULL if empty."""
    n = F.lower(strip(F.substring_index(action, "(", 1)))
    return F.when(n != "", n)


def tool_of(name: Column) -> Column:
    """The registered tool behind a name or an alias of it; NULL if there is none."""
    n = normal_name(name)
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(n.isin(*TOOLS), n).otherwise(alias[n])


def first_object(text: Column) -> Column:
    """Text from the first brace on, code fences removed; the parser of the result ignores what follows the object."""
    t = F.regexp_replace(strip(text), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    at = F.locate("{", t)
    return F.when(at > 0, F.substr(t, at))


def call_arguments(action: Column) -> Column:
    """What stands between the first and the last parenthesis; NULL for another form."""
    a = F.regexp_extract(action, r"(?s)^[^(]*\((.*)\)\s*$", 1)
    return F.when(action.rlike(r"(?s)^[^(]*\(.*\)\s*$"), a)


def guess_action(response: Column) -> Column:
    """Tool named in JSON, else after `Action:`, else the first 200 characters."""
    a = F.regexp_extract(response, r'(?i)"tool"\s*:\s*"([^"]*)"', 1)
    b = F.regexp_extract(response, r"(?i)Action\s*:\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.left(strip(response), F.lit(200)))


def truncate_output(c: Column, limit: int) -> Column:
    """First `limit` characters and a note of how many are missing."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("\n...[truncated "), (F.length(c) - limit).cast("string"), F.lit(" chars]"))).otherwise(c)


def truncate_at_line(c: Column, limit: int, marker: str = "\n[TRUNCATED]") -> Column:
    """Cut at the last line end that fits together with the marker; without a line end, cut hard."""
    head = F.left(c, F.lit(max(0, limit - len(marker))))
    body = F.when(F.locate("\n", head) > 0, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(c) > limit, F.concat(body, F.lit(marker))).otherwise(c)


def has_patch(c: Column) -> Column:
    """Neither NULL, blank nor a marker for no changes."""
    return ~F.coalesce(F.lower(strip(c)), F.lit("")).isin(*EMPTY_PATCHES)


def has_changes(c: Column) -> Column:
    """Whether a rollout left a patch: neither NULL, blank nor the marker `(no changes)`."""
    return ~F.coalesce(strip(c), F.lit("")).isin("", "(no changes)")


def patch_has_body(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?m)^[+-](?![+-])")


def patch_headers(c: Column) -> Column:
    """Distinct paths in +++ and --- headers in order of the headers' kinds, without /dev/null."""
    new = F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ (?:b/)?(.+)$"), 1)
    old = F.regexp_extract_all(c, F.lit(r"(?m)^--- (?:a/)?(.+)$"), 1)
    return F.array_distinct(F.filter(F.concat(new, old), lambda p: strip(p) != "/dev/null"))


def patch_targets(c: Column) -> Column:
    """Sorted distinct paths in +++ headers, time stamps after a tab removed, without /dev/null."""
    new = F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ (.+)$"), 1)
    paths = F.transform(new, lambda p: F.regexp_replace(strip(F.substring_index(p, "\t", 1)), "^b/", ""))
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p != "/dev/null")))


def patch_lines(c: Column, sign: str) -> Column:
    """Number of added (+) or removed (-) lines, headers not counted."""
    return F.regexp_count(c, F.lit(rf"(?m)^\{sign}(?!\{sign}\{sign} )"))


def normal_diff(c: Column) -> Column:
    """Line ends as LF, no blanks at line ends, none around."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"(?m)[ \t]+$", ""))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("long")


def issue_terms(c: Column) -> Column:
    """Distinct lower-case identifiers of at least four characters, in order of occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})"), 1), lambda x: F.lower(x)))


def search_lines(c: Column, n: int = 3) -> Column:
    """The first n of the definitions followed by all lines (a definition counts in both); trimmed, distinct, 4 to 180 characters, no comments."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(x))
    keep = F.array_distinct(F.filter(lines, lambda x: F.length(x).between(4, 180) & ~x.rlike(r"^(#|//|\*|/\*)")))
    return F.slice(F.concat(F.filter(keep, lambda x: x.rlike(r"^(?:async\s+def|def|class|function|func|public|private|protected)\b")), keep), 1, n)


def guarded_ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0 or NULL."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def shell_quote(c: Column) -> Column:
    """The text as one word of a POSIX shell."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def test_command(repo: Column, ids: Column, files: Column | None = None) -> Column:
    """Command that runs the tests of an array of ids: labels for django/django, else distinct files before the `::`, else all tests.

    files: array of the paths in the repository; ids of other files are left out. Without it every path counts as existing.
    """
    ids = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: strip(x) != "")
    django = r"\A([A-Za-z_][A-Za-z0-9_]*) \(([^)]+)\)\z"
    part = lambda x, i: F.regexp_extract(x, django, i)
    labels = F.array_distinct(F.transform(F.filter(ids, lambda x: x.rlike(django)), lambda x: F.concat(part(x, 2), F.lit("."), part(x, 1))))
    paths = F.filter(F.array_distinct(F.transform(ids, lambda x: F.substring_index(x, "::", 1))), lambda p: (p != "") if files is None else F.coalesce(F.array_contains(files, p), F.lit(False)))
    command = lambda start, words: F.concat(F.lit(start), F.array_join(F.transform(words, shell_quote), " "))
    return (
        F.when((repo == "django/django") & (F.size(labels) > 0), command("python tests/runtests.py --verbosity 1 ", labels))
        .when(F.size(paths) > 0, command("python -m pytest -q ", paths))
        .otherwise("python -m pytest -q")
    )


def split_class(split: Column) -> Column:
    """train / validation / test for any spelling or abbreviation; NULL and anything else is in no split."""
    s = F.regexp_replace(F.lower(split), "[^a-z]", "")
    return F.when(s.rlike("^tr(ai?n?)?(ing|set)?$"), "train").when(s.rlike("^(v|va|val|valid|validation|vld|dev|development|eval)(set)?$"), "validation").when(s.rlike("^(t|te|tst|test|testing)(set)?$"), "test")
