"""Parsers and formatters of change texts: hunk headers, blame, commit lines, cuts, patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Hunk headers, with the new side's start and, where given, its count.
HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LOOSE_HEADER = r"@@ -(\d+),?\d* \+(\d+),?\d* @@"
# Files of a repository that state its conventions, in order of priority.
CONVENTIONS = [
    "README.md", "README.rst", "CONTRIBUTING.md", "CONTRIBUTORS.md", "CODE_OF_CONDUCT.md", "ARCHITECTURE.md", "docs/ARCHITECTURE.md",
    "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod", "Cargo.toml", ".eslintrc.js", ".eslintrc.json", "tsconfig.json",
]
# Fixed value: the mark of lines that were added beside others.
ADDED_NEAR = "  ← [ADDED NEAR AI CODE]"


def new_ranges(diff: Column) -> Column:
    """array<struct<s, e>> of the lines that each hunk has on the new side; a hunk without any is left out, one without a count has one."""
    starts, counts = (F.regexp_extract_all(diff, F.lit(HEADER), F.lit(i)) for i in (3, 4))
    both = F.zip_with(starts, counts, lambda s, n: F.struct(s.cast("long").alias("s"), F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(1)).alias("n")))
    return F.transform(F.filter(both, lambda r: r.n > 0), lambda r: F.struct(r.s.alias("s"), (r.s + r.n - 1).alias("e")))


def start_ranges(diff: Column, reach: int = 15) -> Column:
    """array<struct<s, e>> of each hunk's start on the new side and `reach` lines more, whatever its count."""
    return F.transform(F.regexp_extract_all(diff, F.lit(LOOSE_HEADER), F.lit(2)), lambda s: F.struct(s.cast("long").alias("s"), (s.cast("long") + reach).alias("e")))


def blame_entries(blame: Column) -> Column:
    """array<struct<sha, author, content>> of porcelain blame; content is stripped, empty where a block has none."""
    blocks = F.filter(F.split(blame, r"\n(?=[0-9a-f]{40} \d+ \d+)"), lambda b: text.strip(b) != "")
    head = lambda b: text.strip(F.substring_index(b, "\t", 1))
    entries = F.transform(blocks, lambda b: F.struct(F.split(head(b), r"\s+", 3).alias("h"), F.regexp_extract(head(b), r"(?m)^author (.*)$", 1).alias("author"), text.strip(F.regexp_extract(b, r"(?s)^[^\t]*\t(.*)$", 1)).alias("content")))
    return F.transform(F.filter(entries, lambda e: F.size(e.h) >= 2), lambda e: F.struct(e.h[0].alias("sha"), e.author.alias("author"), e.content.alias("content")))


def commit_info(line: Column, message: Column, stat: Column) -> list[Column]:
    """Columns of a log line ``sha|name|mail|date|subject`` (bars in the subject stay; missing parts are empty), message and stat cut."""
    p = F.split(line, r"\|", 5)
    named = [F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("sha", "author_name", "author_email", "author_date", "subject"))]
    return [*named, F.left(message, F.lit(2000)).alias("full_message"), F.left(stat, F.lit(3000)).alias("full_diff_stat")]


def first_lines(x: Column, n: int) -> Column:
    """The first n lines, with a note on how many there are; a text of at most n lines stays as it is."""
    all_ = text.lines(x)
    size = F.size(all_)
    note = F.concat(F.lit("\n... [truncated: "), size.cast("string"), F.lit(f" lines total, showing first {n}]"))
    return F.when(size > n, F.concat(F.array_join(F.slice(all_, 1, n), "\n"), note)).otherwise(x)


def rendered(x: Column, windows: Column) -> Column:
    """Numbered lines of each window (array<struct<s, e>>) under its range."""
    width = lambda w: F.length((w.e + 1).cast("string"))
    block = lambda w: F.transform(F.slice(text.lines(x), w.s.cast("int"), (w.e - w.s + 1).cast("int")), lambda l, i: F.concat(F.lpad((w.s + i).cast("string"), width(w), F.lit(" ")), F.lit("  "), l))
    return F.array_join(F.transform(windows, lambda w: F.concat(F.lit("[lines "), w.s.cast("string"), F.lit("-"), w.e.cast("string"), F.lit("]\n"), F.array_join(block(w), "\n"))), "\n\n")


def patch_text(files: Column) -> Column:
    """Patches of array<struct<filename, patch>> under their names; files without one are left out."""
    held = F.filter(files, lambda f: F.coalesce(f.patch, F.lit("")) != "")
    return F.array_join(F.transform(held, lambda f: F.concat(F.lit("### "), F.coalesce(f.filename, F.lit("?")), F.lit("\n"), f.patch)), "\n\n")


def added_near(diff: Column) -> Column:
    """A diff from its first hunk on, added lines marked, each hunk closed by an empty line."""
    at = F.array_position(F.transform(text.lines(diff), lambda l: l.startswith("@@")), True)
    body = F.when(at > 0, F.slice(text.lines(diff), at, F.size(text.lines(diff))))
    shown = F.transform(body, lambda l, i: F.when(l.startswith("@@") & (i > 0), F.concat(F.lit("\n"), l)).when(text.is_added(l), F.concat(l, F.lit(ADDED_NEAR))).otherwise(l))
    return F.coalesce(F.concat(F.array_join(shown, "\n"), F.lit("\n")), F.lit(""))


def candidate(fields: dict[str, Column]) -> list[Column]:
    """The compact record of a case. Deliberate: a latency of 0 shows as unknown, like a missing one."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    sha = known(fields["sha"])
    latency = F.when(F.coalesce(fields["latency"], F.lit(0)) == 0, "?").otherwise(fields["latency"].cast("string"))
    return [F.left(sha, F.lit(8)).alias("commit_short"), text.one_line(known(fields["message"]), 120).alias("commit_msg"), latency.alias("latency"), text.head(text.strip(F.coalesce(fields["reasoning"], F.lit(""))), 280).alias("reasoning")]


def within_budget(x: Column, most: int) -> Column:
    """A text cut so that it and the note on the cut have `most` characters; nothing but the note where that alone is longer."""
    note = f"\n\n[PR-LEVEL CONTEXT TRUNCATED BY PRE-SPECIFIED {most:,}-CHAR BUDGET; lower-priority suffix omitted.]\n"
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(max(0, most - len(note)))), F.lit(note))).otherwise(x)


# Headings and cuts of a fix's document.
RULE, FIX, PATCH_STEP, DIFF_STEP = "─" * 50, "## FIX COMMIT: ", "  ### STEP 2: Full AI PR patch (for context):", "  ### STEP 3: Full Fix diff (for context):"
PATCH_CUT, DIFF_CUT = (6000, 3500, 2500, "\n... [TRUNCATED: PR patch too long, middle omitted] ...\n"), (8000, 4500, 3500, "\n... [TRUNCATED: fix diff too long, middle omitted] ...\n")
LISTED_ISSUES, TITLE_CHARS = 3, 150


def _middle_cut(x: Column, cut: tuple[int, int, int, str], one_byte: bool = False) -> Column:
    most, head, tail, note = cut
    by = lambda y: F.concat(F.substring(y, 1, head).cast("string"), F.lit(note), F.substring(y, -tail, tail).cast("string"))
    # where each character is a byte, bytes are cut, without counting up to the places; to find that out counts all
    if one_byte:
        return F.when(F.octet_length(x) > most, by(x.cast("binary"))).otherwise(x)
    return F.when(F.octet_length(x) <= most, x).when(F.octet_length(x) == F.length(x), by(x.cast("binary"))).when(F.length(x) > most, by(x)).otherwise(x)


def _fenced(title: str, x: Column, cut: tuple[int, int, int, str], one_byte: bool) -> Column:
    # no text is cut to nothing: what is cut is made once
    return F.when(x != "", F.concat(F.lit(f"\n\n{title}\n  ```diff\n"), _middle_cut(x, cut, one_byte), F.lit("\n  ```"))).otherwise("")


def case_steps(patch: Column, diff: Column, one_byte: bool = False) -> Column:
    """The patch and the diff of a case as a fix's document shows them. Empty ones have no section. one_byte: their characters are known to be a byte each."""
    return F.concat(_fenced(PATCH_STEP, patch, PATCH_CUT, one_byte), _fenced(DIFF_STEP, diff, DIFF_CUT, one_byte))


def fix_document(sha: Column, message: Column, day: Column, days: Column, bucket: Column, cases: Column, issues: Column, blind: bool, stepped: bool = False) -> Column:
    """The document of a fix: head, a section for each of cases (path, verdict, additions, deletions, patch, diff), and linked issues (number, title).

    Blind documents leave out what tells the kind of a case. `stepped` cases have `steps`, made by case_steps, in place of patch and diff: a
    full and a blind document then share them.
    """
    nl = F.lit("\n")
    steps = lambda c: c.steps if stepped else case_steps(c.patch, c["diff"])
    shape = lambda c: F.lit("") if blind else F.concat(F.lit(" (+"), c.additions.cast("string"), F.lit("/-"), c.deletions.cast("string"), F.lit(" lines) ["), c.verdict, F.lit("]"))
    section = lambda c: F.concat(F.lit("\n  File: "), c.path, shape(c), steps(c))
    latency = F.when(bucket != "unknown", F.concat(F.lit("\nLatency bucket: "), bucket)).otherwise("")
    head = F.concat(F.lit(f"\n{RULE}\n{FIX}"), F.substring(sha, 1, 10), F.lit("\nMessage: "), message, F.lit("\nDate: "), day, F.lit(" | Latency: "), F.coalesce(days.cast("string"), F.lit("?")), F.lit(" days after PR merge"), latency)
    files = F.concat(F.lit("\n\nFiles from this PR touched by this fix ("), F.size(cases).cast("string"), F.lit("):\n"), F.array_join(F.transform(cases, section), "\n"))
    named = F.transform(F.slice(issues, 1, LISTED_ISSUES), lambda i: F.concat(F.lit("    - #"), i.number.cast("string"), F.lit(": "), F.substring(i.title, 1, TITLE_CHARS)))
    return F.concat(head, files, F.when(F.size(issues) > 0, F.concat(nl, nl, F.lit("  Linked issues:"), nl, F.array_join(named, "\n"))).otherwise(""))
