"""Text rules: classifiers, references, truncation, diff lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the change classifier, first group that occurs wins.
KEYWORDS = {
    "bug-fix": ["fix", "bug", "hotfix", "regression", "error"],
    "refactor": ["refactor", "restructure", "cleanup", "clean-up", "reorganize", "migrate"],
    "feature": ["feat", "feature", "implement", "support", "add ", "introduce"],
}
# Patterns of the commit classifier, in order of precedence.
COMMIT_RULES = [
    ("RELEASE", r"^(release|version|v\d+\.\d+|merge\s+(branch|pull|release))"),
    ("BUGFIX", r"^(fix|bugfix|hotfix|patch|repair|correct)"),
    ("BUGFIX", r"\b(fix|bug|issue|broken|wrong|incorrect|crash|error)\b"),
    ("FEATURE", r"^(feat|feature|add|implement|introduce|support)"),
    ("REFACTOR", r"^(refactor|chore|cleanup|improve|optimize|style|lint|format|type)"),
    ("REVERT", r"^revert"),
    ("TEST", r"^(test|tests|testing)"),
    ("DOCS", r"^(docs|doc|documentation|readme)"),
]
# Phrases before an issue number, and a bare number after white space.
ISSUE_PATTERNS = [
    r"(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?|ref(?:erence)?s?|addresses?|related\s+to|see|re|part\s+of)\s+#(\d+)",
    r"(?:^|\s)#(\d+)",
]
# Beginnings of comment lines, alone and after a diff sign.
COMMENT = r"^(//|#|--|/\*|\*|<!--|'''|\"\"\")"
COMMENT_AFTER_SIGN = r"^[+-]\s*(//|#|--|/\*|\*|'''|\"\"\")"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def keyword_class(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("other")
    for name, words in reversed(KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def commit_class(message: Column) -> Column:
    low = strip(F.lower(message))
    out = F.lit("OTHER")
    for name, pattern in reversed(COMMIT_RULES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def issue_refs(text: Column) -> Column:
    """Distinct numbers from 1 to 1,000,000 in ascending order."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ISSUE_PATTERNS])
    numbers = F.transform(found, lambda x: x.try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= 1_000_000))))


def head(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def head_tail(text: Column, first: int, last: int, mark: str = "\n...\n") -> Column:
    return F.when(F.length(text) > first + last, F.concat(F.left(text, F.lit(first)), F.lit(mark), F.right(text, F.lit(last)))).otherwise(text)


def one_line(text: Column, n: int) -> Column:
    return F.left(strip(F.regexp_replace(text, "\n", " ")), F.lit(n))


def title_or_first_line(title: Column, body: Column) -> Column:
    """The title, else the body's first line without a heading mark and at most 150 characters, else Unknown."""
    first = F.left(F.regexp_replace(F.split(body, "\n")[0], "^# ", ""), F.lit(150))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(first, F.lit("")), F.lit("Unknown"))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def is_deleted(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def comment_lines(text: Column) -> Column:
    """Lines that are comments, alone or after a diff sign (a ``---`` header counts, as it starts with ``--``)."""
    return F.size(F.filter(lines(text), lambda x: strip(x).rlike(COMMENT) | strip(x).rlike(COMMENT_AFTER_SIGN))).cast("long")


def code_lines(text: Column, least: int = 5) -> Column:
    """Distinct stripped lines longer than `least` characters."""
    return F.array_distinct(F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > least))


def numbered_lines(text: Column, start: int = 1, gap: str = " | ") -> Column:
    """Each line after its number, right-aligned to the width of the largest possible one."""
    all_ = lines(text)
    width = F.length((F.size(all_) + start).cast("string"))
    return F.array_join(F.transform(all_, lambda x, i: F.concat(F.lpad((i + start).cast("string"), width, F.lit(" ")), F.lit(gap), x)), "\n")


def first_json_object(text: Column) -> Column:
    """The text from the first brace to the last, without code fences."""
    return F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)(\{.*\})", 1)


# What a review says where it found nothing, and what stands before each issue.
NO_ISSUES, ISSUE = "key_issues_to_review: []", "issue_header"


def issue_count(review: Column) -> Column:
    """How many issues a review's text lists: -1 without a text, 0 where it says that there are none."""
    headers = (F.length(review) - F.length(F.replace(review, F.lit(ISSUE), F.lit("")))) / len(ISSUE)
    return F.when(F.coalesce(review, F.lit("")) == "", -1).when(review.contains(NO_ISSUES), 0).otherwise(headers).cast("int")
